"""Exact token counts, with huge texts encoded in overlapping chunks that are spliced where both sides must agree.

The vocabulary gives a proof of stable boundaries: between two characters that stand side by side in no piece, no merge
can ever reach across, so every encoding of any surrounding text has a token boundary there. A huge text is cut into chunks
that overlap; both chunks are encoded with offsets, and they are spliced at the first stable boundary of the overlap at
which both have a token boundary. Where an overlap has none, it is widened to twice its length, up to the whole rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Texts of more characters than CHUNK are encoded in chunks of that many bytes, with OVERLAP more.
CHUNK = 50_000
OVERLAP = 256
#: Characters encoded by one call.
CALL = 1 << 21

_SPACE = "▁"
#: A character that is in no piece.
GUARD = "\n"


class Counter:
    """Counts the tokens of texts with a sentencepiece BPE model, without added or special tokens."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        kinds = (self.model.is_control, self.model.is_unknown, self.model.is_byte, self.model.is_unused)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not any(k(i) for k in kinds)]
        self.inside = {x[i : i + 2] for x in pieces for i in range(len(x) - 1)}
        self.whole = not self._plain() or any(GUARD in x for x in pieces)

    def _plain(self) -> bool:
        """Whether characters are encoded as they stand, apart from the space that is put in front."""
        probe = "  A ﬁ  é\n\tx  "
        return all(self.model.decode(self.model.encode(x)) == x for x in (probe, probe.strip(), "a"))

    def stable(self, raw: bytes, at: int) -> bool:
        """Whether a character begins at raw[at] that no piece holds right behind the one before."""
        if raw[at] & 0xC0 == 0x80:
            return False
        pair = raw[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:] + raw[at : at + 4].decode("utf-8", "ignore")[:1]
        return pair.replace(" ", _SPACE) not in self.inside

    def cuts(self, raw: bytes, start: int, end: int) -> list[tuple[int, int]]:
        """(offset, tokens up to it) after each token of raw[start:end]; what doesn't start the text is encoded behind GUARD."""
        found: dict[int, int] = {}
        guard = GUARD if start else ""
        shift, skip = start - len(guard), len(self.model.encode(GUARD)) if start else 0
        for n, piece in enumerate(self.model.encode(guard + raw[start:end].decode("utf-8"), return_type="proto").pieces):
            if n >= skip:
                found[shift + piece.end] = n + 1 - skip  # the last of a character's bytes counts
        return list(found.items())

    def count_huge(self, text: str) -> int:
        """Tokens of a text, from chunks.

        A chunk that doesn't start the text begins at a stable boundary and is encoded behind GUARD, which no piece holds, so
        that the space that the model puts in front can't reach it.
        """
        raw = text.encode("utf-8")
        total, start, n = 0, 0, len(raw)
        width = self.overlap
        while True:
            end = start + self.chunk + width
            while end < n and raw[end] & 0xC0 == 0x80:
                end += 1
            if end >= n:
                guard = GUARD if start else ""
                rest = len(self.model.encode(guard + raw[start:].decode("utf-8")))
                return total + rest - (len(self.model.encode(GUARD)) if start else 0)
            seam = next((at for at in range(max(start, end - width) + 1, end) if self.stable(raw, at)), None)
            spliced = None
            if seam is not None:
                theirs = {x for x, _ in self.cuts(raw, seam, end)} | {seam}
                spliced = next(((x, k) for x, k in self.cuts(raw, start, end) if x in theirs and x < end and self.stable(raw, x)), None)
            if spliced is None:  # alignment fails: widen the overlap
                width *= 2
                continue
            start, total, width = spliced[0], total + spliced[1], self.overlap

    def counts(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        calls: list[list[int]] = [[]]
        size = 0
        for i, t in enumerate(texts):
            if t and len(t) > self.chunk and not self.whole:
                out[i] = self.count_huge(t)
            elif t:
                if size + len(t) > CALL:
                    calls.append([])
                    size = 0
                calls[-1].append(i)
                size += len(t)
        for some in calls:
            for i, ids in zip(some, self.model.encode([texts[i] for i in some], num_threads=1), strict=True):
                out[i] = len(ids)
        return out


@lru_cache(maxsize=2)
def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Counter:
    return Counter(path, chunk, overlap)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of docs (doc_id, text, ...).

    A null or empty text has no bytes and no tokens. Rows that repeat stay; an empty table gives none. The model at `path`
    must lie at that path on every executor.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = counter(path, chunk, overlap).counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(F.col("text").cast("string")).cast("long"), F.lit(0))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), size.alias("n_bytes"))
    found = found.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
