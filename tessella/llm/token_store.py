"""Token ids in Parquet list columns: dictionary-coded ids, delta-coded metadata, small row groups and page indexes."""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, new_path

#: A space between two non-space characters always starts a new pre-token of the byte-level tokenizer, so the
#: pieces between such spaces can be encoded one by one.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RARE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = ["  ", *"\x1c\x1d\x1e\x1f"]
_BREAKS = [(w, " " + w, w + " ") for w in "\n\t\r\x0b\x0c"]


def plainly_spaced(text: str) -> bool:
    """Whether every space of a non-empty text stands between two non-space characters."""
    if text[0].isspace() or text[-1].isspace():
        return False
    for odd in _ODD:
        if odd in text:
            return False
    for w, after, before in _BREAKS:
        if w in text and (after in text or before in text):
            return False
    if not text.isascii():  # one character is searched much faster than a class of them
        for w in _RARE_SPACE:
            if w in text:
                return False
    return True


#: The file format: pages of some thousand rows with column and offset indexes, delta coding for numbers.
FORMAT = {
    "compression": "zstd",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}

_encoders: dict[str, PieceEncoder] = {}
#: fixed values: the byte-level alphabet writes bytes that aren't printable Latin-1 as characters from U+0100 on
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_TAIL = ".,!?;:*#$%&|"


def load_tokenizer(path: str):
    """The tokenizer as the library loads it: an added token's string in a text is that token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Pieces(dict):
    """Piece -> its ids as bytes; what is missing is encoded, and kept while there is room."""

    def __init__(self, tokenizer, before: str, most: int):
        super().__init__()
        self.tokenizer, self.model, self.before, self.most = tokenizer, tokenizer.model, before, most
        self.tails = {}
        self.starts, self.feed = self, self._ids(tokenizer.encode("\n", add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> bytes:
        if "\n" in piece:
            lines = piece.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):  # a line feed between other characters is a pre-token
                return self.feed.join([self[lines[0]], *map(self.starts.__getitem__, lines[1:])])
        if piece.isalpha() and self.before:
            out = self._word(piece)
        else:
            core = piece.rstrip(_TAIL)
            if core != piece and core and core[-1].isalnum():  # marks after a letter or digit are a pre-token of their own
                tail = self.tails.get(piece[len(core) :])
                if tail is None:
                    tail = self.tails[piece[len(core) :]] = self._ids(self.tokenizer.encode(piece[len(core) :], add_special_tokens=False).ids)
                out = self.get(core)
                if out is None:
                    out = self._word(core) if core.isalpha() and self.before else self[core]
                out += tail
            else:
                out = self._ids(self.tokenizer.encode(self.before + piece, add_special_tokens=False).ids)
        if len(self) < self.most:
            self[piece] = out
        return out

    def _word(self, word: str) -> bytes:
        """A word of letters after a space is one pre-token: the model alone, in its own alphabet."""
        if not word.isascii():
            if max(word) > "\u00ff":
                return self._ids(self.tokenizer.encode(" " + word, add_special_tokens=False).ids)
            word = word.encode().decode("latin-1").translate(_BYTES)
        return self._ids([t.id for t in self.model.tokenize("\u0120" + word)])

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class PieceEncoder:
    """Encodes texts with the tokenizer, a space-delimited piece once while it is in the worker's bounded cache."""

    def __init__(self, path: str, most: int = 1_000_000):
        self.tokenizer = load_tokenizer(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first, self.later = _Pieces(self.tokenizer, "", most // 4), _Pieces(self.tokenizer, " ", most)
        self.first.starts = self.later.starts = self.first

    def encode(self, text: str) -> bytes:
        """Ids of one whole text as little-endian 32-bit integers."""
        if not text:
            return b""
        if any(a in text for a in self.added):  # added tokens may hold or touch spaces: the library takes the whole text
            return _Pieces._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = text.split(" ") if plainly_spaced(text) else _CUT.split(text)
        first = self.first[parts[0]]
        return first + b"".join(map(self.later.__getitem__, parts[1:]))


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, partitions: int | None = None) -> None:
    """Encode every whole text, append ``end_id``, and write ``path``/ids (one row per document, ascending ids) and ``path``/chunks.

    Documents are range-partitioned and sorted by id; each task writes one chunk with offsets local to it,
    and the chunk totals give the global offsets, so no task sees more than its range.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, chunk, at = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<i4").tobytes()
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                encoded = [encode(t.as_py() or "") + end for t in batch.column(1)]
                sizes = np.fromiter((len(e) // 4 for e in encoded), np.int64, len(encoded))
                ends = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(encoded), "<i4")))
                starts = at + ends - sizes
                at += int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(sizes), chunk, np.int32)), pa.array(starts), pa.array(sizes), ids],
                    names=["doc_id", "chunk", "local_start", "n_tokens", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, "doc_id long, chunk int, local_start long, n_tokens long, ids array<int>").write.options(**FORMAT).parquet(f"{path}/ids")
    totals = spark.read.parquet(f"{path}/ids").groupBy("chunk").agg(F.sum("n_tokens").alias("n"))
    # one row per chunk (a file of the store), so the running sum is over the number of files
    table, start = [], 0
    for r in sorted(totals.collect()):
        table.append((r.chunk, start, r.n))
        start += r.n
    spark.createDataFrame(table, "chunk int, chunk_start long, chunk_tokens long").coalesce(1).write.parquet(f"{path}/chunks")


def read_tokens(spark: SparkSession, path: str, ids: bool = True, where: str | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens[, ids]) of a store; without ``ids`` no token page is read, and ``where`` reaches the page indexes."""
    rows = spark.read.parquet(f"{path}/ids")
    rows = rows.where(where) if where else rows
    starts = spark.read.parquet(f"{path}/chunks")
    return rows.join(F.broadcast(starts), "chunk").select(  # one row per file of the store
        "doc_id", (F.col("chunk_start") + F.col("local_start")).alias("start"), "n_tokens", *(["ids"] if ids else [])
    )


def ids_crc32(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by the unsigned CRC-32 of its ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = np.fromiter((zlib.crc32(values[i:j]) for i, j in zip(offsets[:-1], offsets[1:])), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Write a token store for ``docs`` in the shared folder and read it back: rows (doc_id, start, n_tokens, ids).

    Defined results: a null or empty text is the end id alone; repeated rows each take their own span, ordered
    by (doc_id, text); rows with a null id come first; an empty table gives an empty store. Other columns are
    not read.
    """
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, id_col, text_col, end_id)
    return read_tokens(docs.sparkSession, path)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return ids_crc32(tokenize(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
