"""Alignment of two tokenizers' tokens: incidence matrices in CSR form, multiplied row by row (Gustavson)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, drop_table, write_table
from tessella.llm.sentencepieces import SPACE
from tessella.llm.token_store import _BYTES, _CUT, _Pieces, load_tokenizer, plainly_spaced


@dataclass
class CSR:
    """A sparse matrix: row i holds ``data[p]`` in the columns ``indices[p]`` for p in ``indptr[i]:indptr[i + 1]``."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, data: np.ndarray, shape: tuple[int, int]) -> CSR:
        """From coordinates whose rows ascend."""
        indptr = np.zeros(shape[0] + 1, np.int64)
        np.cumsum(np.bincount(rows, minlength=shape[0]), out=indptr[1:])
        return cls(indptr, columns, data, shape[1])

    @property
    def height(self) -> int:
        return len(self.indptr) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.height), np.diff(self.indptr))

    def transposed(self) -> CSR:
        order = np.argsort(self.indices, kind="stable")
        return CSR.of(self.indices[order], self.rows()[order], self.data[order], (self.columns, self.height))

    def dot(self, vector: np.ndarray) -> np.ndarray:
        """Matrix times vector."""
        sums = np.concatenate([[0], np.cumsum(self.data * vector[self.indices])])
        return sums[self.indptr[1:]] - sums[self.indptr[:-1]]


def products(a: CSR, b: CSR, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Coordinates (row, column, value) of a·b in ascending order, by Gustavson's row products.

    Each entry (i, k) of ``a`` contributes row k of ``b``; equal columns of a row are added up. Rows of ``a``
    are taken in runs whose contributions number about ``most``, which bounds the memory.
    """
    sizes = np.diff(b.indptr)[a.indices]
    before = np.concatenate([[0], np.cumsum(sizes)])
    at_row = before[a.indptr]
    i = 0
    while i < a.height:
        j = max(i + 1, int(np.searchsorted(at_row, at_row[i] + most, "right")) - 1)
        p, q = a.indptr[i], a.indptr[j]
        n = sizes[p:q]
        if total := int(n.sum()):
            entry = np.repeat(np.arange(p, q), n)
            place = np.arange(total) + np.repeat(b.indptr[a.indices[p:q]] - (before[p:q] - before[p]), n)
            row = np.repeat(np.arange(i, j), np.diff(a.indptr[i : j + 1]))[entry - p]
            key, value = row * b.columns + b.indices[place], a.data[entry] * b.data[place]
            if not np.all(key[1:] > key[:-1]):
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                key, value = key[first], np.add.reduceat(value, first)
            yield key // b.columns, key % b.columns, value
        i = j


def multiplied(a: CSR, b: CSR) -> CSR:
    parts = list(products(a, b)) or [(np.zeros(0, np.int64),) * 3]
    row, column, value = (np.concatenate(x) for x in zip(*parts))
    return CSR.of(row, column, value, (a.height, b.columns))


def token_bytes(sizes: np.ndarray) -> CSR:
    """The token-byte incidence matrix of tokens that follow one another."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    n = int(ends[-1])
    return CSR(ends, np.arange(n), np.ones(n, np.int64), n)


def overlap_groups(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A token and of every B token, from their overlaps.

    A·Bᵀ over bytes links the tokens that share bytes. In order, two links that follow one another have a
    token in common unless both tokens end at the same byte: there a new group starts.
    """
    links = multiplied(token_bytes(a_sizes), token_bytes(b_sizes).transposed())
    row, column = links.rows(), links.indices
    new = np.concatenate([[False], (row[1:] != row[:-1]) & (column[1:] != column[:-1])])
    group = np.cumsum(new)
    of_a, of_b = np.zeros(len(a_sizes), np.int64), np.zeros(len(b_sizes), np.int64)
    of_a[row], of_b[column] = group, group
    return of_a, of_b


def group_links(of_a: np.ndarray, a_ids: np.ndarray, of_b: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, A id, B id, links) of all tokens that share a group: group-incidence matrices multiplied.

    Equal ids of a group are one row with their number, so a long group costs its distinct ids squared.
    """

    def rows(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, n = np.unique(group << 32 | ids, return_counts=True)
        return key >> 32, key & 0xFFFFFFFF, n

    (ga, ia, na), (gb, ib, nb) = rows(of_a, a_ids), rows(of_b, b_ids)
    groups = int(ga[-1]) + 1 if len(ga) else 0
    incidence = CSR.of(np.arange(len(ga)), ga, na, (len(ga), groups))
    shared = multiplied(incidence, CSR.of(gb, np.arange(len(gb)), nb, (groups, len(gb))))
    row = shared.rows()
    return ga[row], ia[row], ib[shared.indices], shared.data


class Tokens:
    """Both tokenizers of a worker: ids and bytes of a space-delimited piece, with the space before it."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        tokenizer = load_tokenizer(a_path)
        tokenizer.encode_special_tokens = True
        byte = {ord(c): i for i, c in ((i, chr(_BYTES.get(i, i))) for i in range(256))}
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[ord(c)] for c in entry) if all(ord(c) in byte for c in entry) else entry.encode()
        self.a = _Pieces(tokenizer, " ", 100_000)
        self.a.starts = _Pieces(tokenizer, "", 25_000)  # after a line feed no space goes before
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode() for i in range(self.b.get_piece_size())
        ]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and number of ids by piece, by A and by B; none by either where the joined bytes aren't those of space and piece."""
        a = [self.a[p] for p in pieces]
        a_ids, a_len = np.frombuffer(b"".join(a), "<u4").astype(np.int64), np.fromiter(map(len, a), np.int64, len(a)) // 4
        b = self.b.encode(pieces, num_threads=1)
        b_ids, b_len = np.fromiter(chain.from_iterable(b), np.int64), np.fromiter(map(len, b), np.int64, len(b))
        want = [(" " + p).encode() for p in pieces]
        lost = np.zeros(len(pieces), bool)
        for ids, size, table in ((a_ids, a_len, self.a_bytes), (b_ids, b_len, self.b_bytes)):
            parts = list(map(table.__getitem__, ids.tolist()))
            ends = np.cumsum(size).tolist()
            if b"".join(parts) == b"".join(want):
                sums = np.add.reduceat(np.fromiter(map(len, parts), np.int64, len(parts)), np.cumsum(size) - size) if size.all() else None
                if sums is not None and np.array_equal(sums, np.fromiter(map(len, want), np.int64, len(want))):
                    continue
            lost |= np.fromiter((b"".join(parts[j - n : j]) != w for j, n, w in zip(ends, size.tolist(), want)), bool, len(want))
        if lost.any():
            a_ids, b_ids = a_ids[np.repeat(~lost, a_len)], b_ids[np.repeat(~lost, b_len)]
            a_len, b_len = np.where(lost, 0, a_len), np.where(lost, 0, b_len)
        return a_ids, a_len, b_ids, b_len


_loaded: dict[tuple[str, str], Tokens] = {}


def tokens_of(a_path: str, b_path: str) -> Tokens:
    """One pair of tokenizers per worker process."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Tokens(a_path, b_path)
    return _loaded[a_path, b_path]


def split_pieces(text: str) -> list[str]:
    """Cut at spaces between two other characters, where tokens of both tokenizers always end."""
    return text.split(" ") if plainly_spaced(text) else _CUT.split(text)


@dataclass
class Aligned:
    """A block of texts: ``per_text`` counts pieces by text, ``links`` the links of each piece by id pair, ``pairs`` the pairs."""

    n: dict[str, np.ndarray]
    digests: list[str]
    per_text: CSR
    links: CSR
    pairs: np.ndarray
    n_texts: np.ndarray


def align_texts(texts: list[str | None], tokens: Tokens) -> Aligned:
    """Align whole texts, each distinct piece of the block once. ``n_texts`` is in how many texts of the block a pair is linked."""
    number: dict[str, int] = {}
    each = [[number.setdefault(p, len(number)) for p in split_pieces(t)] if t else [] for t in texts]
    a_ids, a_len, b_ids, b_len = tokens.encoded(list(number))
    of_a, of_b = overlap_groups(tokens.a_sizes[a_ids], tokens.b_sizes[b_ids])
    group, ia, ib, n = group_links(of_a, a_ids, of_b, b_ids)
    piece_of_group = np.zeros(int(of_a[-1]) + 1 if len(of_a) else 0, np.int64)
    piece_of_group[of_a] = np.repeat(np.arange(len(number)), a_len)
    pairs, pair = np.unique(ia << 32 | ib, return_inverse=True)
    by_group = CSR.of(group, pair, n, (len(piece_of_group), len(pairs)))
    in_piece = CSR.of(piece_of_group, np.arange(len(piece_of_group)), np.ones(len(piece_of_group), np.int64), (len(number), len(piece_of_group)))
    links = multiplied(in_piece, by_group)

    written = _written(a_ids, of_a, b_ids, of_b, piece_of_group)
    lost = set(np.flatnonzero(a_len == 0).tolist())
    each = [[] if lost and not lost.isdisjoint(x) else x for x in each]
    digests = [hashlib.sha256(";".join(map(written.__getitem__, x)).encode()).hexdigest() if x else "" for x in each]
    per_text = _counted(each, len(number))
    ones = CSR(per_text.indptr, per_text.indices, np.ones_like(per_text.data), per_text.columns)
    n_texts = np.zeros(len(pairs), np.int64)
    for _, column, _ in products(ones, links):
        n_texts += np.bincount(column, minlength=len(pairs))
    sums = {"n_a": a_len, "n_b": b_len, "n_groups": np.diff(in_piece.indptr), "n_links": links.dot(np.ones(len(pairs), np.int64))}
    return Aligned({k: per_text.dot(v) for k, v in sums.items()}, digests, per_text, links, pairs, n_texts)


def _counted(each: list[list[int]], columns: int) -> CSR:
    size = np.fromiter(map(len, each), np.int64, len(each))
    key, n = np.unique(np.repeat(np.arange(len(each)), size) * max(columns, 1) + np.fromiter((i for x in each for i in x), np.int64, int(size.sum())), return_counts=True)
    return CSR.of(key // max(columns, 1), key % max(columns, 1), n, (len(each), columns))


def _written(a_ids: np.ndarray, of_a: np.ndarray, b_ids: np.ndarray, of_b: np.ndarray, pieces: np.ndarray) -> list[str]:
    """The groups of each piece as ``a1,a2|b1;a3|b2,b3``; ``pieces`` is the piece of every group."""
    ids, group, side = np.concatenate([a_ids, b_ids]), np.concatenate([of_a, of_b]), np.repeat([0, 1], [len(a_ids), len(b_ids)])
    order = np.argsort(group << 1 | side, kind="stable")
    ids, group, side = ids[order], group[order], side[order]
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 10))
    ends = np.cumsum(digits + 1) - 1  # of the digits; there the mark goes
    out = np.empty(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    for k in range(int(digits.max(initial=0))):
        some = digits > k
        out[ends[some] - 1 - k] = 48 + ids[some] // 10**k % 10
    follows = lambda x: x[1:] == x[:-1]
    out[ends[:-1]] = np.where(~follows(group), ord(";"), np.where(follows(side), ord(","), ord("|")))
    text = out.tobytes()
    last = np.bincount(pieces[group], minlength=int(pieces.max(initial=-1)) + 1)
    stop = [-1, *np.where(last > 0, ends[np.maximum(np.cumsum(last) - 1, 0)], -1).tolist()] if len(ends) else []
    parts, at = [], 0
    for end in stop[1:]:
        parts.append(text[at:end].decode() if end >= at else "")
        at = max(at, end + 1)
    return parts


_MATRICES = [f"{m}_{part}" for m in ("per_text", "links") for part in ("indptr", "indices", "data")]


def _pack(values: np.ndarray) -> bytes:
    """Compressed 32-bit integers (64-bit ones where a value needs it), after their kind and size: a block is a narrow row for the JVM."""
    kind = "<i4" if values.max(initial=0) < 1 << 31 else "<i8"
    raw = values.astype(kind).tobytes()
    return kind.encode() + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: pa.Buffer) -> np.ndarray:
    head = packed.slice(0, 11).to_pybytes()
    size = int.from_bytes(head[3:], "little")
    raw = pa.decompress(packed.slice(11), decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    return np.frombuffer(raw, head[:3].decode()).astype(np.int64)


def align_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, block_chars: int) -> DataFrame:
    """One row per block of documents (about ``block_chars`` characters): counts by document, sparse matrices as bytes, and the block's id pairs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, n = tokens_of(a_path, b_path), TaskContext.get().partitionId(), 0
        for ids, texts in _blocks(batches, block_chars):
            x = align_texts(texts, tokens)
            lists = [ids, *(pa.array(x.n[k]) for k in ("n_a", "n_b", "n_groups", "n_links")), pa.array(x.digests, pa.string())]
            lists += [pa.array(x.pairs >> 32), pa.array(x.pairs & 0xFFFFFFFF), pa.array(x.n_texts)]
            raw = [getattr(m, array) for m in (x.per_text, x.links) for array in ("indptr", "indices", "data")]
            columns = [pa.array([part << 32 | n]), *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists), *(pa.array([_pack(v)], pa.binary()) for v in raw)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "a", "b", "n_texts", *_MATRICES])
            n += 1

    longs = "".join(f", {c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    schema = f"block long, ids array<{kind}>{longs}, digests array<string>, a array<long>, b array<long>, n_texts array<long>" + "".join(f", {m} binary" for m in _MATRICES)
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _blocks(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[tuple[pa.Array, list[str | None]]]:
    for batch in batches:
        before = np.cumsum([0, *(len(t.as_py() or "") for t in batch.column(1))])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(before, before[i] + block_chars, "right")) - 1)
            yield batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i).to_pylist()
            i = j


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Rows (a, b, n, best): in how many documents an id pair is linked, and whether no pair of that A id is in more. A written table.

    Blocks hold each of their pairs once, so what is shuffled is the blocks' distinct pairs.
    """
    rows = blocks.select(F.explode(F.arrays_zip("a", "b", "n_texts")).alias("p")).select("p.*")
    counts = write_table(rows.groupBy("a", "b").agg(F.sum("n_texts").alias("n")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    out = write_table(counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")
    drop_table(counts)
    return out


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Align tokenizer A (byte-level, a tokenizers file) with B (a SentencePiece model) over whole texts.

    Returns the documents, rows (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the
    links of ids, rows (a, b, n, best) with the number of documents. A task takes blocks of about
    ``block_chars`` characters (a longer text is a block of its own); a block goes through the shuffle as its
    distinct id pairs and two sparse matrices: pieces by text and links by piece. Products with the vectors of
    corpus-wide counts then give each text's figures.

    Defined results: null and empty texts, and those that a tokenizer doesn't give back byte by byte, have
    zeros and an empty digest; special tokens' strings are plain text; repeated rows each count and each give
    a row; null ids are kept; an empty table gives empty tables; other columns are not read.
    """
    blocks = write_table(align_blocks(docs, a_path, b_path, id_col, text_col, block_chars), "alignment")
    counts = pair_counts(blocks)
    place = blocks.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("at", "p")).select("block", "at", "p.*")
    back = place.join(counts, ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("at", "n", F.col("best").cast("long").alias("best"))).alias("p"))
    back = back.select("block", *(F.col(f"p.{c}").cast("array<long>").alias(f"p_{c}") for c in ("at", "n", "best")))
    sums, kind = ("n_a", "n_b", "n_groups", "n_links"), docs.schema[id_col].dataType.simpleString()
    full = blocks.join(back, "block", "left").select("ids", *sums, "digests", *_MATRICES, "p_at", "p_n", "p_best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                raw = {m: _unpack(row[m].as_buffer()) for m in _MATRICES}
                values = {c: (row[c].values.to_numpy() if row[c].is_valid else np.zeros(0, np.int64)) for c in ("p_at", "p_n", "p_best")}
                links = CSR(*(raw[f"links_{x}"] for x in ("indptr", "indices", "data")), len(values["p_at"]))
                per_text = CSR(*(raw[f"per_text_{x}"] for x in ("indptr", "indices", "data")), links.height)
                n, best = np.zeros(links.columns, np.int64), np.zeros(links.columns, np.int64)
                n[values["p_at"]], best[values["p_at"]] = values["p_n"], values["p_best"]
                figures = [pa.array(per_text.dot(links.dot(v))) for v in (best, n)]
                columns = [row["ids"].values, *(row[c].values for c in sums), *figures, row["digests"].values]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *sums, "n_best", "count_sum", "groups_sha256"])

    longs = "".join(f"{c} long, " for c in (*sums, "n_best", "count_sum"))
    return full.mapInArrow(run, f"id {kind}, {longs}groups_sha256 string"), counts


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align(documents(spark, sf_dir), *files)[0].withColumnRenamed("id", "doc_id")
