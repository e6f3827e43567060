"""SentencePiece encoding and decoding over a relational lattice of pieces."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, drop_table, write_table

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Words end before a space mark that follows another character: no piece goes over that place.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}\n\t]+|{SPACE}+|\n|\t")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol-buffer message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class PieceModel:
    """The pieces of a model file: matchable pieces with scores, byte pieces, and the text of every id."""

    kind: int
    scores: dict[str, tuple[float, int]]
    byte_ids: list[int] | None
    unknown: int
    texts: list[bytes]

    @property
    def longest(self) -> int:
        return max(map(len, self.scores), default=1)


def load_model(path: str) -> PieceModel:
    """Read a .model file. The rules of its normaliser aren't read: text is taken as it is, as with the identity rule."""
    with open(path, "rb") as f:
        data = f.read()
    kind, scores, bytes_, unknown, texts = UNIGRAM, {}, {}, 0, []
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            piece, score, type_ = got[1].decode(), float(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0]), got.get(3, 1)
            i = len(texts)
            texts.append(b"" if type_ in (2, 3) else bytes([int(piece[3:5], 16)]) if type_ == 6 else piece.replace(SPACE, " ").encode())
            if type_ == 6:
                bytes_[int(piece[3:5], 16)] = i
            elif type_ == 2:
                unknown = i
            elif type_ in (1, 4):
                scores[piece] = score, i
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
    return PieceModel(kind, scores, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None, unknown, texts)


def words_of(text: str) -> list[str]:
    """The words of a text, space marks included, in order: their encodings joined are the encoding of the text."""
    return _WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []


def lattice(words: DataFrame, model: PieceModel) -> DataFrame:
    """Rows (word, edges): all pieces that occur in each word, found by an equi-join of its bounded substrings.

    The piece table is broadcast: its size is that of the model file.
    """
    spark = words.sparkSession
    pieces = spark.createDataFrame([(p, s, i) for p, (s, i) in model.scores.items()], "piece string, score double, id int")
    starts = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    longest = F.least(F.lit(model.longest), F.length("word") - F.col("at") + 1)
    cut = starts.select("word", "at", F.explode(F.sequence(F.lit(1), longest)).alias("n"))
    cut = cut.select("word", "at", "n", F.substring("word", F.col("at"), F.col("n")).alias("piece"))
    edge = F.struct((F.col("at") - 1).alias("s"), (F.col("at") + F.col("n") - 1).alias("e"), "score", "id")
    return cut.join(F.broadcast(pieces), "piece").groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def merge_fold(word: Column, edges: Column) -> Column:
    """Boundaries of the byte-pair segmentation: a fold that joins, again and again, the best two neighbours.

    Spans of characters are joined if their union is an edge; the highest score goes first, then the leftmost.
    """
    start = F.sequence(F.lit(0), F.length(word))

    def step(bounds: Column, _: Column) -> Column:
        at = lambda e: F.array_position(bounds, e["s"]).cast("int")
        able = F.filter(edges, lambda e: (at(e) > 0) & (F.get(bounds, at(e) + 1) == e["e"]))
        ranked = F.transform(able, lambda e: F.struct(e["score"].alias("score"), (-e["s"]).alias("left"), F.get(bounds, at(e)).alias("middle")))
        best = F.array_max(ranked)
        return F.when(F.size(able) > 0, F.array_remove(bounds, best["middle"])).otherwise(bounds)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), start, step)


def viterbi_fold(word: Column, edges: Column, unknown_score: float = -1e4) -> Column:
    """Boundaries of the segmentation with the highest sum of scores (unigram models), by a fold over end positions."""
    best = "array<struct<total:double,path:array<int>>>"
    first = F.array(F.struct(F.lit(0.0).alias("total"), F.array(F.lit(0)).alias("path"))).cast(best)

    def step(state: Column, end: Column) -> Column:
        here = F.filter(edges, lambda e: e["e"] == end)
        ways = F.transform(here, lambda e: F.struct((F.get(state, e["s"])["total"] + e["score"]).alias("total"), F.concat(F.get(state, e["s"])["path"], F.array(end)).alias("path")))
        last = F.get(state, end - 1)
        way = F.array(F.struct((last["total"] + F.lit(unknown_score)).alias("total"), F.concat(last["path"], F.array(end)).alias("path")))
        return F.concat(state, F.slice(F.array_sort(F.concat(ways, way).cast(best), lambda a, b: F.when(a["total"] > b["total"], -1).when(a["total"] < b["total"], 1).otherwise(0)), 1, 1))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(word)), first, step), -1)["path"]


def encode_words(words: DataFrame, model: PieceModel) -> DataFrame:
    """Rows (word, bounds, ends): the segmentation of each word, and the ids of its edges by (start, end) as ``ends``."""
    full = words.join(lattice(words, model), "word", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<s:int,e:int,score:double,id:int>>")))
    fold = merge_fold if model.kind == BPE else viterbi_fold
    bounds = fold(F.col("word"), F.col("edges"))
    ids = F.transform(
        F.sequence(F.lit(0), F.size("bounds") - 2),
        lambda i: F.coalesce(F.get(F.filter("edges", lambda e: (e["s"] == F.get("bounds", i)) & (e["e"] == F.get("bounds", i + 1))), F.lit(0))["id"], F.lit(-1)),
    )
    return full.withColumn("bounds", bounds).select("word", "bounds", ids.alias("ids"))


class WordEncoder:
    """The same segmentations inside a task: a bounded table of solved words, and the fold itself for the others."""

    def __init__(self, model: PieceModel, table: dict[str, bytes], most: int = 600_000):
        self.model, self.table, self.most = model, dict(table), most + len(table)

    def _fallback(self, span: str) -> list[int]:
        return [self.model.byte_ids[b] for b in span.encode("utf-8", "replace")] if self.model.byte_ids else [self.model.unknown]

    def ids(self, word: str) -> list[int]:
        spans = self._merge(word) if self.model.kind == BPE else self._viterbi(word)
        out: list[int] = []
        for span in spans:
            hit = self.model.scores.get(span)
            out += [hit[1]] if hit else self._fallback(span)
        return out

    def _merge(self, word: str) -> list[str]:
        scores, parts = self.model.scores, list(word)
        if len(parts) <= 40:
            none = (float("-inf"), 0)
            gain = [scores.get(x + y, none)[0] for x, y in zip(parts, parts[1:])]
            while gain and (best := max(gain)) > none[0]:
                i = gain.index(best)  # the leftmost
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del gain[i]
                if i:
                    gain[i - 1] = scores.get(parts[i - 1] + parts[i], none)[0]
                if i < len(gain):
                    gain[i] = scores.get(parts[i] + parts[i + 1], none)[0]
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (hit := scores.get(parts[i] + parts[j])):
                heapq.heappush(heap, (-hit[0], i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if not parts[i] or after[i] >= len(parts) or parts[i] + parts[after[i]] != joined:
                continue
            j = after[i]
            parts[i], parts[j], after[i] = joined, "", after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def _viterbi(self, word: str, unknown_score: float = -1e4) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            ways = [(best[end - 1][0] + unknown_score, end - 1)]
            for start in range(max(0, end - self.model.longest), end):
                if hit := self.model.scores.get(word[start:end]):
                    ways.append((best[start][0] + hit[0], start))
            best.append(max(ways, key=lambda w: w[0]))
        out, end = [], len(word)
        while end:
            out.append(word[best[end][1] : end])
            end = best[end][1]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        words, table = words_of(text), self.table
        try:
            return b"".join([table[w] for w in words])
        except KeyError:
            out = []
            for w in words:
                got = table.get(w)
                if got is None:
                    got = np.array(self.ids(w), "<i4").tobytes()
                    if len(table) < self.most:
                        table[w] = got
                out.append(got)
            return b"".join(out)


def decode(model: PieceModel, ids) -> str:
    """The text of a sequence of ids: spaces for space marks, the first one left out, bytes joined."""
    out = b"".join([model.texts[i] for i in ids]).decode("utf-8", "replace")
    return out[1:] if out[:1] == " " else out


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows (word, n): every word of every whole text, counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                counts.update(words_of(t.as_py() or ""))
                if len(counts) > 400_000:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int, longest: int) -> DataFrame:
    """The most frequent words of at most ``longest`` characters, ``most`` of them or fewer, by a histogram of counts.

    Counts up to 64 have a bucket each, larger ones 64 for each doubling, so the histogram has some thousand rows however
    often words occur. Buckets are taken from the top while all their words fit; the first that doesn't fit ends it.
    """
    n = F.col("n")
    level = F.when(n <= 64, n).otherwise(64 + F.floor((F.log2(n) - 6) * 64)).cast("long")
    some = counts.where(F.length("word") <= longest).withColumn("level", level)
    least, total = None, 0
    for r in some.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # some thousand rows at most
        total += r.words
        if total > most:
            break
        least = r.level
    return some.where(F.col("level") >= least if least is not None else F.lit(False)).select("word")


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", table_words: int = 150_000, table_longest: int = 32, decoded: bool = True) -> DataFrame:
    """Rows (id, ids[, decoded]), one per row of ``docs``: the piece ids of every whole text, and the text they decode to.

    Frequent words (at most ``table_words``, which bounds what is broadcast) are segmented once by the lattice: substrings
    exploded, joined to the piece table, grouped by word and folded. Words outside that table are folded
    in the task over the same pieces. Defined results: a null or empty text has no ids and decodes to an
    empty text; characters without a piece become byte pieces (or the unknown id); repeated rows each give a
    row; an empty table gives no rows; other columns are not read.
    """
    spark, model = docs.sparkSession, load_model(model_path)
    counts = write_table(word_counts(docs, text_col), "word-counts")
    chosen = write_table(frequent_words(counts, table_words, table_longest), "frequent-words")
    drop_table(counts)
    helper = WordEncoder(model, {}, 0)
    table = {}
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    solved = write_table(encode_words(chosen.repartition(tasks, "word"), model), "word-ids")  # few bytes, much work
    for r in solved.toLocalIterator():  # bounded by table_words
        ids = []
        for i, a, b in zip(r.ids, r.bounds, r.bounds[1:]):
            ids += [i] if i >= 0 else helper._fallback(r.word[a:b])
        table[r.word] = np.array(ids, "<i4").tobytes()
    drop_table(chosen)
    drop_table(solved)
    shared = spark.sparkContext.broadcast((model, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value
        encoder = WordEncoder(model, table)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                encoded = [encoder.encode(t.as_py() or "") for t in batch.column(1)]
                ends = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), "<i4")))
                texts = [pa.array([decode(model, np.frombuffer(e, "<i4").tolist()) for e in encoded], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, *texts], names=["id", "ids", "decoded"][: 2 + len(texts)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, ids array<int>{', decoded string' * decoded}")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.concat_ws(",", F.transform("ids", lambda i: i.cast("string")))
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), F.crc32(ids.cast("binary")).alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))
