"""Line-first cleaning, with DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules; failing
lines go, then a document that lost too much of its text is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import packed, unpacked, with_window_hashes

#: White space that parts words.
SPACE = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
#: Fixed phrases of page furniture and legal footers; a short line that holds one is boilerplate.
BOILERPLATE = (
    # English
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "copyright ©", "subscribe to our newsletter", "sign up for", "click here", "read more", "share this",
    "javascript is disabled", "enable javascript", "lorem ipsum", "powered by", "back to top", "skip to content",
    # French
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "cliquez ici", "en savoir plus", "lire la suite", "abonnez-vous", "utilise des cookies", "retour en haut",
    # German
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "impressum", "hier klicken", "mehr erfahren", "weiterlesen", "newsletter abonnieren", "verwendet cookies", "nach oben",
    # Spanish
    "todos los derechos reservados", "condiciones de uso", "política de privacidad", "aviso legal", "haga clic aquí", "leer más", "seguir leyendo", "suscríbete a", "utiliza cookies", "volver arriba",
)


#: A word that ends as sentences do, perhaps before closing quotes or brackets.
SENTENCE_END = r"[.!?…:;。！？][\"'”’»)\]]*(?:[\x20\x09-\x0D]|$)"


@dataclass(frozen=True)
class LineRules:
    max_symbol_share: float = 0.12  # symbols in the line's characters
    max_nav_bars: int = 3  # "|" or ">" separators standing alone: a menu or table row
    max_shout_share: float = 0.5  # words that end in two exclamation marks
    unended_words: int = 4  # a line of so many words or more in which none ends a sentence is no prose
    boilerplate_words: int = 10  # a boilerplate phrase condemns lines of up to so many words; in longer ones it may be part of a sentence
    max_lost_share: float = 0.5  # of the characters in words; above, the document goes


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def has_word(text: Column) -> Column:
    return text.rlike(NO_SPACE)


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return (F.size(F.split(text, SYMBOL, -1)) - 1).cast("long")


def with_repeat_words(docs: DataFrame, words: str, window: int, out: str) -> DataFrame:
    """docs with the number of words inside windows found twice or more in the text, the first occurrence included.

    Windows are equal when their 64-bit hashes are. Only texts that repeat a window sort theirs: equal hashes meet,
    their places are put in order, and one fold adds up what they cover.
    """
    docs = with_window_hashes(docs, words, window, "_hashes")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    docs = docs.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) == F.size("_hashes"), none).otherwise(F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = F.greatest(F.size("_sorted") - 1, F.lit(0))
    docs = docs.withColumn("_same", F.zip_with(F.slice("_sorted", 1, pairs), F.slice("_sorted", 2, pairs), lambda a, b: a["h"] == b["h"]))
    either = F.zip_with(F.concat("_same", F.array(F.lit(False))), F.concat(F.array(F.lit(False)), "_same"), lambda a, b: a | b)
    docs = docs.withColumn("_places", F.array_sort(F.filter(F.zip_with("_sorted", either, lambda m, e: F.when(e, m["i"])), lambda p: p.isNotNull())))
    state = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    total = F.aggregate("_places", state, lambda s, p: F.struct((p + window).alias("upto"), (s["n"] + p + window - F.greatest(p, s["upto"])).alias("n")), lambda s: s["n"])
    return docs.withColumn(out, total.cast("long")).drop("_hashes", "_sorted", "_same", "_places")


def line_facts(lines: Column, rules: LineRules) -> Column:
    """For each line an array element with its words' number and characters, and its lower-case form if it is short."""

    def facts(line: Column) -> Column:
        pieces = F.split(line, SPACE)
        return F.struct(line.alias("line"), F.size(F.filter(pieces, lambda w: w != "")).alias("n_words"), word_chars(pieces).alias("chars"))

    return F.transform(lines, facts)


def line_verdicts(facts: Column, rules: LineRules) -> Column:
    """The facts of lines that stay; lines without a word stay as they are. Costly patterns run only on lines that hold their marks."""

    def stays(x: Column) -> Column:
        line, n_words = x["line"], x["n_words"]
        bars = F.when(line.contains("|") | line.contains(">") | line.contains("»"), F.regexp_count(line, F.lit(r"(?:^|[\x20\x09])[|>»](?=[\x20\x09]|$)"))).otherwise(0)
        shouts = F.when(line.contains("!!"), F.regexp_count(line, F.lit(r"!!(?=[\x20\x09-\x0D]|$)"))).otherwise(0)
        phrase = F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda p: x["low"].contains(p))
        return ~(
            (symbol_count(line) > x["chars"] * rules.max_symbol_share)
            | (bars > rules.max_nav_bars)
            | ((n_words >= rules.unended_words) & ~line.rlike(SENTENCE_END))
            | (shouts > F.greatest(F.lit(2), n_words * rules.max_shout_share))
            | phrase
        )

    low = F.transform(facts, lambda x: x.withField("low", F.when(x["n_words"] <= rules.boilerplate_words, F.lower(x["line"])).otherwise("")))
    return F.filter(low, lambda x: (x["n_words"] == 0) | stays(x))


def line_first(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text") -> DataFrame:
    """docs with clean_text, lines_removed and lost_share added (columns of those names are replaced).

    Null is read as the empty text; a text without words loses nothing. Repeated rows are judged alike.
    """
    text = _text(F.col(text_col))
    out = docs.drop("clean_text", "lines_removed", "lost_share", "_facts", "_kept", "_whole", "_left").withColumn("_facts", line_facts(F.split(text, "\n", -1), rules))
    out = out.withColumn("_kept", line_verdicts(F.col("_facts"), rules))
    chars = lambda facts: F.aggregate(facts, F.lit(0).cast("long"), lambda n, x: n + x["chars"])
    out = out.withColumns({"clean_text": F.array_join(F.transform("_kept", lambda x: x["line"]), "\n"), "lines_removed": (F.size("_facts") - F.size("_kept")).cast("long"), "_whole": chars("_facts"), "_left": chars("_kept")})
    return out.withColumn("lost_share", F.when(F.col("_whole") == 0, 0.0).otherwise((F.col("_whole") - F.col("_left")) / F.col("_whole"))).drop("_facts", "_kept", "_whole", "_left")


def clean(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text") -> DataFrame:
    """Documents that keep enough text, with the failing lines removed.

    Columns, whatever their names, stay those of docs with their values. Null and empty texts, and texts no line of which
    fails, come out as they went in, repeated rows each on its own; no rows give none.
    """
    kept = line_first(packed(docs, text_col, text_col), rules).where(F.col("lost_share") <= rules.max_lost_share)
    return unpacked(kept, docs.columns, **{text_col: F.when(F.col("lines_removed") > 0, F.col("clean_text")).otherwise(F.col("text"))})


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed beside the columns of docs (of
    those names they are replaced). A null text has no words and no lines; repeated rows count each on its own; no rows give none."""
    text = _text(F.col(text_col))
    out = with_repeat_words(docs.withColumn("_words", words_of(text)), "_words", window, "n_repeat_words")
    worded = F.filter(F.split(text, "\n", -1), has_word)
    out = out.withColumns({"n_words": F.size("_words").cast("long"), "word_chars": word_chars(F.col("_words")), "n_symbols": symbol_count(text), "_lines": worded})
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_words", "_lines")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
