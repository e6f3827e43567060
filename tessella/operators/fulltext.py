"""A positional inverted index in files, boolean queries over it, and ranking by cover density."""

from __future__ import annotations

import io
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import fold
from tessella.operators.lemmas import lexemes, special_words, words_of
from tessella.sources.tables import discard, written

SPECIAL = 1_000_000  #: so many words with terms of their own are broadcast, at most
FLUSH = 1_000_000  #: hits of whole documents that are grouped at a time
DOCUMENTS = 400_000  #: documents whose postings of a bucket go to one task


@dataclass(frozen=True)
class Dictionaries:
    """What turns words into terms: affix rules, stems and the stop list (see ``operators.lemmas``)."""

    rules: DataFrame
    stems: DataFrame
    stop: DataFrame


@dataclass(frozen=True)
class TextQuery:
    """Clauses joined by OR, each a list of slots that must all be there; a slot is a word with its alternative terms."""

    slots: tuple[tuple[str, ...], ...]
    clauses: tuple[tuple[int, ...], ...]

    @property
    def terms(self) -> list[str]:
        return sorted({t for s in self.slots for t in s})


def all_words(id_col: str, text_col: str, key_col: str | None = None) -> Column:
    """The words of key and text as they are, and once more without accents."""
    whole = F.concat_ws(" ", *([F.col(key_col)] if key_col else []), F.col(text_col))
    return words_of(F.concat_ws(" ", whole, fold(whole)))


def positions(rows: DataFrame, id_col: str, text_col: str, key_col: str | None = None) -> DataFrame:
    """(id, pos, word) of key and text as they are, and once more without accents; positions run on."""
    return rows.select(F.col(id_col).alias("id"), F.posexplode(all_words(id_col, text_col, key_col)).alias("pos", "word"))


def _once(rows: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id no other row has, and the others (None if there are none)."""
    ids = written(rows.groupBy(F.col(id_col).alias("__id")).count().where("count > 1").select("__id"), "repeated-ids")
    if ids.isEmpty():
        discard(ids)
        return rows, None
    same = rows[id_col].eqNullSafe(ids["__id"])
    return rows.join(ids, same, "left_anti"), rows.join(ids, same, "left_semi")


def _termed(tokens: DataFrame, special: DataFrame) -> DataFrame:
    """Tokens (word in lower case, ...) with ``term`` in place of ``word``, a row per term; ``special`` (see ``special_words``) is broadcast, so that rows stay in their order."""
    met = tokens.join(F.broadcast(special), "word", "left")  # SPECIAL rows at most
    return met.withColumn("term", F.explode(F.coalesce("terms", F.array(fold("word"))))).drop("word", "terms")


def _by_documents(batches: Iterator[pa.RecordBatch], group: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``group`` of tables of whole documents (column ``row``, equal in a stretch of rows) of some FLUSH rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held, size = [*held, batch], size + batch.num_rows
        if size >= FLUSH:
            whole = pa.Table.from_batches(held)
            row = np.asarray(whole["row"].combine_chunks())
            end = int(np.flatnonzero(row != row[-1])[-1]) + 1 if row[0] != row[-1] else 0
            if end:
                yield from group(whole.slice(0, end))
            held, size = whole.slice(end).combine_chunks().to_batches(), size - end
    if size:
        yield from group(pa.Table.from_batches(held))


def _terms_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of the documents and of the terms of a table's rows, and the terms."""
    row = np.asarray(table["row"].combine_chunks())
    terms = table["term"].combine_chunks().dictionary_encode()
    return np.concatenate([[0], np.cumsum(row[1:] != row[:-1])]).astype(np.int64), np.asarray(terms.indices).astype(np.int64), terms.dictionary


def term_counts(rows: DataFrame, dictionaries: Dictionaries, id_col: str, text_col: str, key_col: str | None = None) -> DataFrame:
    """(term, docs, n): in how many documents and at how many positions of them each term stands, by the ``positions`` of the rows.

    Words are counted where they are read, and only counts are shuffled. Documents of a term are counted in the task that reads them, as all hits
    of a row are there. Rows that share an id are one document, so theirs are grouped by id; documents without an id count for n alone.
    """
    d = dictionaries
    once, more = _once(rows, id_col)
    words = all_words(id_col, text_col, key_col)
    counted = written(once.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    special = written(special_words(counted.select("word"), d.rules, d.stems, d.stop), "special-words")

    def by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(table: pa.Table) -> Iterator[pa.RecordBatch]:
            doc, term, names = _terms_of(table)
            docs = np.bincount(np.unique(doc * len(names) + term) % len(names), minlength=len(names))
            yield pa.RecordBatch.from_pydict({"term": names, "docs": docs.astype(np.int64), "n": np.zeros(len(names), np.int64)})

        return _by_documents(batches, group)

    if special.count() <= SPECIAL:
        n = _termed(counted, special).select("term", F.lit(0).cast("long").alias("docs"), "n")
        each = once.where(F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.array_distinct(words).alias("words")).select("row", F.explode("words").alias("word"))
        parts = [n, _termed(each, special).select("row", "term").mapInArrow(by_term, "term string, docs long, n long")]
    else:
        parts, more = [], rows
    if more is not None:
        by_doc = lexemes(positions(more, id_col, text_col, key_col), d.rules, d.stems, d.stop).groupBy("term", "id").agg(F.countDistinct("pos").alias("n"))
        parts.append(by_doc.select("term", F.col("id").isNotNull().cast("long").alias("docs"), "n"))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def write_index(rows: DataFrame, path: str, dictionaries: Dictionaries, id_col: str, text_col: str, key_col: str | None = None, buckets: int = 64) -> None:
    """Write postings (bucket, term, id, positions) under ``path``, a folder per bucket of terms, sorted by term and id.

    A posting is a row, so a term of very many documents stays many rows in many row groups. Postings are grouped in the task that reads
    their document and shuffled once, packed by bucket; a bucket of very many documents is dealt over several tasks. Rows that share an id are
    one document, so theirs are grouped by id and added.
    """
    d = dictionaries
    once, more = _once(rows, id_col)
    words = all_words(id_col, text_col, key_col)
    vocabulary = written(once.select(F.explode(words).alias("word")).distinct(), "vocabulary")
    special = written(special_words(vocabulary, d.rules, d.stems, d.stop), "special-words")
    discard(vocabulary)
    if special.count() > SPECIAL:
        once, more = rows.limit(0), rows
    kind = dict(rows.dtypes)[id_col]
    salts = -(-once.count() // DOCUMENTS) or 1
    hits = once.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words.alias("words")).select("row", "id", F.posexplode("words").alias("pos", "word"))
    packed = _termed(hits, special).select("row", "id", "pos", "term").mapInArrow(_packing(buckets), "bucket int, salt long, packed binary")
    packed = packed.repartition(buckets * salts, "bucket", F.pmod(F.xxhash64("salt"), F.lit(salts))).select("packed")
    postings = packed.mapInArrow(_unpacked, f"bucket int, term string, id {kind}, positions array<int>")
    postings.sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(path, compression="zstd")
    discard(special)
    if more is not None:
        terms = lexemes(positions(more, id_col, text_col, key_col), d.rules, d.stems, d.stop)
        postings = terms.groupBy("term", "id").agg(F.array_sort(F.collect_set("pos")).alias("positions"))
        postings = postings.withColumn("bucket", bucket_of(F.col("term"), buckets)).hint("rebalance", "bucket")
        postings.sortWithinPartitions("bucket", "term", "id").write.mode("append").partitionBy("bucket").parquet(path, compression="zstd")


def _packing(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hits (row, id, pos, term), documents in one stretch each and positions in order, to a few rows (bucket, salt, packed): postings as Parquet bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(table: pa.Table) -> Iterator[pa.RecordBatch]:
            doc, term, names = _terms_of(table)
            bucket = np.array([zlib.crc32(t.encode()) % buckets for t in names.to_pylist()], np.int64)
            order = np.lexsort((doc, term, bucket[term]))  # stable, so positions stay in order
            doc, term = doc[order], term[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]))
            at = pa.ListArray.from_arrays(pa.array(np.append(new, len(doc)), pa.int32()), table["pos"].combine_chunks().cast(pa.int32()).take(pa.array(order)))
            rows = pa.table({"bucket": pa.array(bucket[term[new]], pa.int32()), "term": names.take(pa.array(term[new])), "id": table["id"].combine_chunks().take(pa.array(order[new])), "positions": at})
            cuts = np.append(np.searchsorted(bucket[term[new]], np.arange(buckets)), len(new))
            filled = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            packed = []
            for b in filled:
                out = io.BytesIO()
                pq.write_table(rows.slice(cuts[b], cuts[b + 1] - cuts[b]), out, compression="zstd", use_dictionary=["term", "bucket"], write_statistics=False, store_schema=False)
                packed.append(out.getvalue())
            salt = int(np.asarray(table["row"].chunk(0))[0])
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(filled, pa.int32()), "salt": pa.array([salt] * len(filled), pa.int64()), "packed": pa.array(packed, pa.binary())})

        return _by_documents(batches, group)

    return pack


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch["packed"]:
            yield from pq.read_table(io.BytesIO(packed.as_py())).to_batches(10_000)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def read_postings(spark: SparkSession, path: str, terms: Sequence[str], buckets: int = 64) -> DataFrame:
    """Postings of these terms only: their buckets' folders, and in them the row groups that may hold them."""
    some = sorted({zlib.crc32(t.encode()) % buckets for t in terms})
    return spark.read.parquet(path).where(F.col("bucket").isin(some) & F.col("term").isin(list(terms))).select("term", "id", "positions")


def text_query(spark: SparkSession, variants: Sequence[str], dictionaries: Dictionaries) -> TextQuery:
    """A query of wordings: the words of the first (what was typed) are joined by OR, those of each other wording by AND, and wordings by OR.

    Words that the dictionaries drop don't count; a word with several lemmas matches any of them.
    """
    asked = spark.createDataFrame(list(enumerate(variants)), "variant int, text string")
    words = asked.select("variant", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    found = lexemes(words, dictionaries.rules, dictionaries.stems, dictionaries.stop).groupBy("variant", "pos").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    slots, clauses, wordings = [], [], {}
    for r in sorted(found.collect(), key=lambda r: (r.variant, r.pos)):  # the words of one question
        if tuple(r.terms) not in slots:
            slots.append(tuple(r.terms))
        at = slots.index(tuple(r.terms))
        if r.variant == 0:
            clauses.append((at,))
        else:
            wordings.setdefault(r.variant, []).append(at)
    clauses += [tuple(dict.fromkeys(c)) for c in wordings.values()]
    return TextQuery(tuple(slots), tuple(dict.fromkeys(clauses)))


def cover_ranks(postings: DataFrame, asked: TextQuery) -> DataFrame:
    """(id, rank) of the documents that fulfil the query: the sum over minimal covers of 1 / (1 + words in it that aren't asked for).

    A cover is a stretch of text that fulfils some clause and holds no shorter one. One fold over a document's hits in
    order of position finds them: for each slot it keeps the last hit; the latest start of a fulfilled clause
    begins a cover unless the one before began there too.
    """
    named = {t: [i for i, s in enumerate(asked.slots) if t in s] for t in asked.terms}
    slots = F.create_map(*[x for t, at in named.items() for x in (F.lit(t), F.array(*map(F.lit, at)))])
    hits = F.flatten(F.transform("positions", lambda p: F.transform(F.element_at(slots, F.col("term")), lambda s: F.struct(p.alias("pos"), s.alias("slot")))))
    by_doc = postings.select("id", hits.alias("hits")).groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    place = "struct<n:int,pos:int>"
    nowhere = F.struct(F.lit(-1).alias("n"), F.lit(-1).alias("pos")).cast(place)
    start = F.struct(
        F.array(*[nowhere] * len(asked.slots)).alias("last"), F.lit(-1).alias("n"), F.lit(-1).alias("pos"), F.lit(-1).alias("begun"), F.lit(0.0).alias("rank")
    ).cast(f"struct<last:array<{place}>,n:int,pos:int,begun:int,rank:double>")

    def step(state: Column, i: Column) -> Column:
        hit, after = F.get("hits", i), F.get("hits", i + 1)
        n = F.when(hit["pos"] == state["pos"], state["n"]).otherwise(state["n"] + 1)
        here = F.struct(n.alias("n"), hit["pos"].alias("pos")).cast(place)
        marked = F.transform(state["last"], lambda x, s: F.when(s == hit["slot"], here).otherwise(x))

        def covered(last: Column) -> Column:
            first = F.array_max(F.array(*[F.array_min(F.array(*[F.get(last, F.lit(s)) for s in c])) for c in asked.clauses]))
            return F.struct(last.alias("last"), first.alias("first"))

        def judged(x: Column) -> Column:
            whole = F.coalesce(after["pos"] != hit["pos"], F.lit(True))  # all hits of this position are in
            cover = whole & (x["first"]["n"] > state["begun"])
            noise = (hit["pos"] - x["first"]["pos"]) - (n - x["first"]["n"])
            return F.struct(
                x["last"].alias("last"), n.alias("n"), hit["pos"].alias("pos"), F.when(cover, x["first"]["n"]).otherwise(state["begun"]).alias("begun"),
                (state["rank"] + F.when(cover, 1.0 / (1 + noise)).otherwise(0.0)).alias("rank"),
            )

        once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  computed once, used often
        return once(once(marked, covered), judged)

    folded = F.aggregate(F.sequence(F.lit(0), F.size("hits") - 1), start, step, lambda s: s["rank"])
    return by_doc.select("id", folded.alias("rank")).where("rank > 0")


def text_ranks(spark: SparkSession, path: str, asked: TextQuery, buckets: int = 64) -> DataFrame:
    """(id, rank) over a written index; an empty query finds nothing."""
    if not asked.clauses:
        return spark.createDataFrame([], "id long, rank double")
    return cover_ranks(read_postings(spark, path, asked.terms, buckets), asked)
