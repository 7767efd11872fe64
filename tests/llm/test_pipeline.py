"""The pipeline as a whole against plain Python, on rows with every oddity at once."""

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_dedup import classes
from tests.llm.test_layout import encode
from tests.llm.test_text_rules import hits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, component string, key string, predicted int, words string"


def made(r):
    """(doc_id, text) of originals, near and exact copies, shared passages, benchmark texts, and rows without ids or texts."""
    say = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    shared, item = "this passage of more than fifty bytes stands in several documents of the table", say(30)
    texts = [say(r.choice([40, 80, 150])) for _ in range(14)]
    docs = list(enumerate(texts))
    docs += [(20 + i, t + " end") for i, t in enumerate(texts[:4])]  # near copies
    docs += [(30 + i, t) for i, t in enumerate(texts[2:6])]  # exact copies
    docs += [(40 + i, f"{say(20)} {shared} {say(25)}") for i in range(4)]
    docs += [(50, item), (51, f"{item} {say(5)}"), (52, say(20_000)), (53, None), (54, ""), (None, say(30)), (None, None), (3, texts[3])]
    return docs, item


def expected(docs, item):
    """[(doc_id, text)] that reach packing."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t in docs)]
    near = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    of = classes(range(len(docs)), near)
    groups = {}
    for i, c in of.items():
        groups.setdefault(c, []).append(docs[i])
    kept = [min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()]
    kept.sort(key=lambda d: (d[0] is None, d[0] or 0))
    seen, out = set(), []
    for i, t in kept:
        b = (t or "").encode()
        gone = bytearray(len(b))
        own = [b[p : p + 50] for p in range(len(b) - 49)]
        for p, s in enumerate(own):
            if s in seen:
                gone[p : p + 50] = b"\1" * 50
        seen |= set(own)
        left = bytes(x for x, g in zip(b, gone) if not g).decode()
        if not b.strip() or left.strip():
            out.append((i, left if t is not None else None))
    n_hit = [(d, hits(d[1], [("b", item)])) for d in out]
    return [d for d, (n, hit, _) in n_hit if 2 * hit <= n]


@pytest.mark.parametrize("seed", [1, 2])
def test_pipeline_matches_plain_python(spark, tmp_path, seed):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(seed)
    docs, item = made(r)
    r.shuffle(docs)
    rows = [(i, t, r.choice(["en", None]), None, len(t or ""), 1, "c", "k", None, "w") for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")  # nothing to learn from: all stay
    spark.createDataFrame([("b", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert stages["quality"](spark, table, str(tmp_path)).count() == len(docs)
    want = sorted(((str(i), k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for i, t in expected(docs, item) for ids in [encode(t, 0)] for k, at in enumerate(range(0, len(ids), 2048))))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(x["doc_id"]), x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == want
    for k in range(1, 4):
        out = list(stages.values())[k](spark, table, str(tmp_path))
        assert out.columns == table.columns and [f.dataType for f in out.schema] == [f.dataType for f in table.schema]


def test_one_of_rows_that_share_id_and_text(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(1, text, lang, n) for n, lang in enumerate(["en", "de", None, "fr"])], "doc_id long, text string, lang string, n int")
    picked = {corpus_pipeline.near_dedup(spark, rows.repartition(k).orderBy(F.desc("n") if k % 2 else "n"), "").first()["n"] for k in (1, 2, 3)}
    assert len(picked) == 1


def test_empty_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
