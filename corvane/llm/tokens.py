"""Encoding whole texts with a public tokenizer inside tasks."""

from __future__ import annotations

import os

#: A control character that stands alone as a token.
BAR = "\x01"


class WordEncoder:
    """Ids of whole texts, as packed little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its words in a row.
    Each word is encoded once and kept; the memo is emptied when it holds `memo` words, so memory stays bounded.
    """

    def __init__(self, path: str, memo: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), memo, {}
        self.bar = self.tokenizer.encode(BAR, add_special_tokens=False).ids

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Null and empty texts give no ids."""
        import numpy as np

        split = [(t or "").encode().split() for t in texts]
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        new = list({w for words in split for w in words if w not in known})
        plain = [w for w in new if BAR.encode() not in w] if len(self.bar) == 1 else []
        # Many words in one string, with a control character between them whose one id tells where each ends.
        parts = [plain[at : at + 200] for at in range(0, len(plain), 200)]
        lines = [f" {BAR} ".join(w.decode() for w in part) for part in parts]
        for part, got in zip(parts, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            ends = [*np.flatnonzero(ids == self.bar[0]).tolist(), len(ids)]
            packed, start = ids.tobytes(), 0
            for word, end in zip(part, ends, strict=True):
                known[word] = packed[4 * start : 4 * end]
                start = end + 1
        for word in new:
            if word not in known:
                known[word] = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return [b"".join(map(known.__getitem__, words)) for words in split]


#: Encoders of this worker process: tasks that follow each other find the words known.
_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder_for(path: str, memo: int = 1_000_000) -> WordEncoder:
    if (path, memo) not in _ENCODERS:
        _ENCODERS[path, memo] = WordEncoder(path, memo)
    return _ENCODERS[path, memo]


def forget_encoders() -> None:
    """Free this worker's encoders and what they remember, where later stages need the memory more than the words."""
    _ENCODERS.clear()


def batches(rows, size: int = 4 << 20):
    """Arrow batches cut so that their texts (column "text") hold about so many bytes each."""
    import pyarrow.compute as pc

    for batch in rows:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            held += n
            if held >= size:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
