"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Three steps. `pieces` tokenises each document where it is read and emits one small row per piece (identifier,
place, length, checksum); token ids never travel. Pieces of full length are sequences of their own. The others are
dealt by a hash of their identifier into shards of bounded size, and each shard is packed by best-two-fit:

1. fill: a bin takes documents in descending length while they fit;
2. trade: take out the smallest document of the bin and look for the two unpacked documents whose joint length fits
   the expanded gap more tightly; if the pair leaves a smaller gap than before, it replaces that document.

Shards hold lengths as a histogram, so that a step costs a scan over lengths, not over documents.

Defined results: a null text is an empty document (its only token is the closing id); a repeated document is packed
as often as it occurs; an empty table gives an empty table; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Word parts whose ids one Python worker keeps; beyond it the table starts anew.
CACHE_WORDS = 700_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Characters outside the plain range: texts with any of them take the tokenizer's own path.
ODD = re.compile("[^\t\n\r -~\u00c0-\u012f\u0131-\u024f]")
#: The vocabulary's own splitting, for texts of the plain range after lower-casing.
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class WordIds:
    """Ids of texts from remembered ids of their parts.

    Word-end vocabularies lower-case a text, split it by a fixed pattern and merge inside each part, so the ids of a
    text are those of its parts one after the other. `exact` is that path; it holds for the plain range of characters
    and for a vocabulary of this kind. Everything else is encoded by the tokenizer, word by word: spaces and newlines
    always separate parts.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            self.exact = '"end_of_word_suffix":"</w>"' in re.sub(r"\s", "", f.read(20_000))
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = byte_letters()
        self.mapped = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x250)}
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        ids = [t.id for t in self.tokenizer.model.tokenize(part.translate(self.mapped))]
        return np.asarray(ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.exact and not ODD.search(text) and not any(x in text for x in self.specials):
            known, keys, make = self.parts, PART.findall(text.lower()), self.part
        else:
            known, keys, make = self.words, text.replace("\n", " ").split(" "), self.word
        try:
            return b"".join(map(known.__getitem__, keys))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for k in set(keys):
                if k not in known:
                    known[k] = make(k)
            return b"".join(map(known.__getitem__, keys))


def pieces(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32.

    vocabulary: a file for `tokenizers`, at the same place on every executor; by default the installed
    word_bpe_49k.json, found there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        words, end = WordIds(path), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            for at in range(0, len(ids), 256):
                for doc, text in zip(ids[at : at + 256], texts.slice(at, 256).fill_null("").to_pylist(), strict=True):
                    data = words.ids(text) + end
                    for k, start in enumerate(range(0, len(data), 4 * limit)):
                        piece = data[start : start + 4 * limit]
                        rows.append((doc, k, start // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_two_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins of lengths. Works on a histogram; every length is in 1..limit."""
    count = [0] * (limit + 1)
    for n in lengths:
        count[n] += 1
    left, largest, bins = len(lengths), limit, []

    def below(n: int) -> int:
        """The largest length with documents left that is at most n; 0 if there is none."""
        n = min(n, largest)
        while n > 0 and not count[n]:
            n -= 1
        return n

    smallest = 1
    while left:
        largest = below(largest)
        gap, box = limit, []
        while gap and (n := below(gap)):
            count[n] -= 1
            box.append(n)
            gap -= n
        left -= len(box)
        while smallest <= limit and not count[smallest]:
            smallest += 1
        if gap and left >= 2 and len(box) > 1 and smallest <= limit:
            room = box[-1] + gap
            best, pair = box[-1], None
            a = below(room - smallest)
            while a and a >= room - a:  # the larger of the two; the smaller follows from the room
                count[a] -= 1
                b = below(room - a)
                count[a] += 1
                if b and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = below(a - 1)
            if pair:
                count[box[-1]] += 1
                smallest = min(smallest, box[-1])
                largest = max(largest, box[-1])
                count[pair[0]] -= 1
                count[pair[1]] -= 1
                left -= 1
                box[-1:] = pair
        bins.append(box)
    return bins


def pack(found: DataFrame, limit: int = 2048, shard_rows: int = 4_000) -> DataFrame:
    """Adds sequence_id and offset to the rows of `pieces`.

    Each shard wastes at most its last few sequences; shard_rows bounds both that share and a task's memory. The
    shard count follows from the pieces themselves."""
    total = found.where(F.col("length") < limit).count()
    shards = max(1, -(-total // shard_rows))
    full = F.col("length") >= limit
    keyed = found.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.drop_columns(["shard"])
        order = np.lexsort([table.column(c).to_numpy(zero_copy_only=False) for c in ("ids_crc32", "piece", "doc_id")])
        table = table.take(pa.array(order))
        n = table.column("length").to_numpy()
        by: dict[int, list[int]] = {}
        for i in range(len(n) - 1, -1, -1):
            by.setdefault(int(n[i]), []).append(i)
        sequence, offset = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        for k, box in enumerate(best_two_fit(n.tolist(), limit), start=shard << 32):
            at = 0
            for x in box:
                i = by[x].pop()
                sequence[i], offset[i] = k, at
                at += x
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    packed = keyed.where(~full).groupBy("shard").applyInArrow(run, PIECES + ", sequence_id long, offset long")
    # a full piece fills its sequence; its number is above those of all shards and made where the row is
    alone = found.where(full).select("*", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def best_fit_packing(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, end_id: int = 0, shard_rows: int = 4_000) -> DataFrame:
    from leafwright.llm.runtime import stored

    return pack(stored(pieces(docs, vocabulary, limit, end_id)), limit, shard_rows)
