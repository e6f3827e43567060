"""Personal data and secrets replaced by keyed surrogates of the same type and format (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, drop_table, write_table

# fixed values: titles that announce a person, and the gender they tell
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|госпожа|г-жа"
MALE = "Mr|Herr|Señor|Sr|Monsieur|господин|г-н"
# fixed values: given names that surrogates use first
GIVEN = {
    ("f", "latin"): ["Anna", "Clara", "Elena", "Greta", "Irene", "Julia", "Laura", "Marta", "Nora", "Paula"],
    ("m", "latin"): ["Anton", "Bruno", "David", "Emil", "Felix", "Hugo", "Jonas", "Lukas", "Oscar", "Peter"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Мария"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Павел"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "so", "tu", "va", "wi", "zo", "lu"],
    "cyrillic": ["ба", "ве", "ги", "до", "за", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "фе", "жу", "лу"],
}

NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{FEMALE}|{MALE})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?"
PATTERNS = {
    "secret": r"(?<![\p{L}\p{N}])(?i:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_\-]{8,}+",
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63}){1,8}",
    "key": r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,48}+)(?![\p{L}\p{N}])",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\p{L}\p{N}:])",
    "ip": r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])\d(?:[ \-]?\d){12,18}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
    "phone": r"(?:\+\d{1,3}(?:[ .\-]?\(?\d{2,4}\)?){2,5}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|(?<![\p{L}\p{N}])\d{3}[ .\-]\d{3}[ .\-]\d{4})(?![\p{L}\p{N}])",
    "name": NAME,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
MAYBE = rf"[0-9@]|AKIA|sk-|gh[pousr]_|(?:[A-Fa-f]+:){{7}}|{FEMALE}|{MALE}|(?i:token|passw|pwd|secret|key)"  #: some part of every entity
_SECRET_HEAD = r"^(.*?[=:]\s{0,3}[\"']?)(.*)$"


def find_entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, row, pos, hit): the entity strings of each text in order; ``row`` is a hash of the text."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), text.alias("text")).where(F.col("text").rlike(MAYBE))
    hits = rows.select("id", "row", F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("pos", "hit"))
    return hits


def kind_of(hit: Column) -> Column:
    """The type of an entity string: the first pattern that matches all of it."""
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(hit.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _script(token: Column) -> Column:
    return F.when(token.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))


def entities_of(hits: DataFrame) -> DataFrame:
    """Rows (hit, kind, part, entity, canon): what an entity string refers to, one row per name token.

    Spellings of one thing share ``canon``: case of an email, separators of a number. A name is its given name
    (with the gender that the title tells) and its surname, so later mentions by surname alone agree.
    """
    h = F.col("hit")
    digits = F.regexp_replace("hit", r"\D", "")
    kind = hits.select("hit", kind_of(h).alias("kind"))
    plain = kind.where("kind != 'name'").select(
        "hit", "kind", F.lit(0).alias("part"), F.col("kind").alias("entity"),
        F.when(F.col("kind") == "email", F.lower("hit"))
        .when(F.col("kind") == "phone", F.right(digits, F.lit(10)))  # with or without the country code, one number
        .when(F.col("kind").isin("card", "ssn"), digits)
        .when(F.col("kind") == "ipv6", F.lower("hit"))
        .when(F.col("kind") == "iban", F.regexp_replace("hit", " ", ""))
        .when(F.col("kind") == "secret", F.regexp_extract("hit", _SECRET_HEAD, 2))
        .otherwise(h).alias("canon"),
    )
    tokens = F.split(F.regexp_extract("hit", r"^\S+ (.*)$", 1), " ")
    gender = F.when(h.rlike(f"^(?:{FEMALE})[. ]"), F.lit("f")).otherwise(F.lit("m"))
    names = kind.where("kind = 'name'").select("hit", "kind", gender.alias("g"), F.size(tokens).alias("n"), F.posexplode(tokens).alias("part", "canon"))
    given = (F.col("part") == 0) & (F.col("n") > 1)
    entity = F.when(given, F.concat(F.lit("given_"), "g", F.lit("_"), _script(F.col("canon")))).otherwise(F.concat(F.lit("surname_"), _script(F.col("canon"))))
    return plain.unionByName(names.select("hit", "kind", "part", entity.alias("entity"), "canon"))


def _at(v: Column, i: Column) -> Column:
    return F.element_at(v, (i % F.size(v) + 1).cast("int"))


def _pick(options: list[str], v: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (v % len(options) + 1).cast("int"))


def _mapped(text: Column, v: Column, keep: Column, hex_only: Column) -> Column:
    """Each digit and letter of ``text`` from position ``keep`` on replaced by one of its kind; other characters stay."""

    def one(c: Column, i: Column) -> Column:
        x = _at(v, i)
        from_ = lambda alphabet: F.substring(F.lit(alphabet), (x % len(alphabet) + 1).cast("int"), F.lit(1))
        return (
            F.when(i < keep, c)
            .when(hex_only & c.rlike("^[0-9a-f]$"), from_("0123456789abcdef"))
            .when(c.rlike(r"^[0-9]$"), from_("0123456789"))
            .when(c.rlike(r"^\p{IsCyrillic}$"), F.when(c == F.lower(c), from_("абвгдежзиклмнопрстуфхцчшэюя")).otherwise(from_("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ")))
            .when(c.rlike(r"^\p{IsGreek}$"), F.when(c == F.lower(c), from_("αβγδεζηθικλμνξοπρστυφχψω")).otherwise(from_("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")))
            .when(c.rlike(r"^\p{Lu}$"), from_("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"^\p{L}$"), from_("abcdefghijklmnopqrstuvwxyz"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn test of a digit string; a valid number gives a multiple of 10."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, (F.length(digits) - i).cast("int"), F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def draw(todo: DataFrame, key: str) -> DataFrame:
    """Rows (entity, canon, attempt, fake): the surrogate at that attempt, a pure function of the key and the three.

    What several types need is a column of its own (the keyed numbers ``v``, the mapped ``digits``), so the plan stays small.
    """
    seed = lambda block: F.sha2(F.concat_ws("\x1f", F.lit(key), "entity", "canon", F.col("attempt").cast("string"), F.lit(block)), 512)
    rows = todo.withColumn("digest", F.concat(seed("0"), seed("1")))
    rows = rows.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.conv(F.substring("digest", (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")))
    v, canon, entity, none, no = F.col("v"), F.col("canon"), F.col("entity"), F.lit(0), F.lit(False)
    local, domain = F.regexp_extract("canon", "^(.*)@", 1), F.regexp_extract("canon", "@(.*)$", 1)
    labels = F.regexp_extract(domain, r"^(.*?)(?:[^.]+\.)?[^.]+$", 1)  # what stands before the registered name
    keep = F.when(entity == "card", 1).when(entity == "iban", 2).when(entity == "key", 4).otherwise(none)
    hexes = ((entity == "secret") & canon.rlike("^[0-9a-f]+$")) | (entity == "ipv6")
    # every fourth attempt makes surrogates of free length longer, every 32nd those of a fixed format, so no space of values is used up
    longer, beyond = F.floor(F.col("attempt") / 4).cast("int"), F.floor(F.col("attempt") / 32).cast("int")
    letters = lambda n: F.array_join(F.transform(F.slice(v, F.lit(20), n), lambda x: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), x % 26 + 1, F.lit(1))), "")
    figures = F.array_join(F.transform(F.slice(v, F.lit(20), beyond), lambda x: (x % 10).cast("string")), "")
    rows = rows.withColumn("head", F.when(entity == "email", local).otherwise(canon)).withColumn("keep", keep).withColumn("hexes", hexes)
    rows = rows.withColumn("mapped", _mapped(F.col("head"), v, F.col("keep"), F.col("hexes")))
    rows = rows.withColumn("sub", F.when(entity == "email", _mapped(labels, F.reverse(v), none, no)).otherwise(""))
    body = F.concat(F.substring("mapped", F.lit(1), F.length("mapped") - 1), F.lit("0"))
    rows = rows.withColumn("check", F.when(entity == "card", F.when(_luhn(canon) % 10 == 0, (10 - _luhn(body) % 10) % 10)))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_at(v, i) % 254 + 1).cast("string")), ".")
    email = F.concat("mapped", letters(longer), F.lit("@"), "sub", _pick(["example.com", "example.org", "example.net"], _at(v, F.lit(126))))
    card = F.when(F.col("check").isNull(), F.col("mapped")).otherwise(F.concat(F.substring("mapped", F.lit(1), F.length("mapped") - 1), F.col("check").cast("string")))
    out = F.when(entity == "email", email).when(entity == "ip", F.concat(ip, figures)).when(entity == "card", F.concat(card, figures))
    out = out.when(entity.isin("phone", "ssn", "iban", "secret", "key", "ipv6"), F.concat("mapped", figures))
    for script, parts in SYLLABLES.items():
        more = F.array_join(F.transform(F.slice(v, F.lit(40), longer), lambda x: F.element_at(F.array(*[F.lit(p) for p in parts]), x % len(parts) + 1)), "")  # noqa: B023
        family = F.initcap(F.concat(*[_pick(parts, _at(v, F.lit(i))) for i in range(4)], more))
        out = out.when(entity == f"surname_{script}", family)
        for gender, end in (("f", {"latin": "na", "cyrillic": "на"}), ("m", {"latin": "n", "cyrillic": "н"})):
            made = F.initcap(F.concat(*[_pick(parts, _at(v, F.lit(i))) for i in range(3)], more, F.lit(end[script])))
            listed = _pick(GIVEN[gender, script], _at(v, F.lit(9)))
            out = out.when(entity == f"given_{gender}_{script}", F.when(F.col("attempt") < 3, listed).otherwise(made))
    return rows.select("entity", "canon", "attempt", out.alias("fake"))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """Rows (entity, canon, fake): distinct things of one type get distinct surrogates, none of which is a real one.

    Every round draws surrogates for the undecided; of those that draw the same, or one that is taken or real, all but
    the first (by canon) draw again with the next attempt.
    """
    todo = write_table(entities.select("entity", "canon").distinct().withColumn("attempt", F.lit(0)), "pii-todo")
    real = todo.select("entity", F.col("canon").alias("fake"))
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work
    done: DataFrame | None = None
    while not todo.isEmpty():
        drawn = write_table(draw(todo.repartition(tasks, "canon"), key), "pii-drawn")
        first = drawn.groupBy("entity", "fake").agg(F.min("canon").alias("canon")).join(real, ["entity", "fake"], "left_anti")
        if done is not None:
            first = first.join(done.select("entity", "fake"), ["entity", "fake"], "left_anti")
        good = write_table(first.select("entity", "canon", "fake"), "pii-done")  # a table for each round: what is decided is not written again
        done = good if done is None else done.unionByName(good)
        rest = drawn.join(good.select("entity", "canon"), ["entity", "canon"], "left_anti").select("entity", "canon", (F.col("attempt") + 1).alias("attempt"))
        todo = write_table(rest, "pii-todo")
        drop_table(drawn)
    return done if done is not None else real.select("entity", F.col("fake").alias("canon"), "fake")


def _poured(hit: Column, digits: Column) -> Column:
    """The characters of ``digits`` put in the places of the letters and digits of ``hit``; what has no place follows."""
    chars = F.split(hit, "")

    def one(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(hit, F.lit(1), (i + 1).cast("int")), r"[^A-Za-z0-9]", ""))
        return F.when(c.rlike("^[A-Za-z0-9]$"), F.substring(digits, before.cast("int"), F.lit(1))).otherwise(c)

    places = F.length(F.regexp_replace(hit, r"[^A-Za-z0-9]", ""))
    return F.concat(F.array_join(F.transform(chars, one), ""), F.substring(digits, places + 1, F.length(digits)))


def replacements(hits: DataFrame, key: str) -> DataFrame:
    """Rows (hit, new, tokens): the string that takes the place of each distinct entity string, in its own format.

    ``tokens`` are a name's words with their surrogates, (canon, fake), and empty for other types.
    """
    parts = write_table(entities_of(hits.select("hit").distinct()), "pii-entities")
    named = parts.join(assign(parts, key), ["entity", "canon"])
    fakes = named.groupBy("hit", "kind").agg(F.array_sort(F.collect_list(F.struct("part", "fake", "canon"))).alias("fakes"))  # one or two per string
    fake = F.element_at("fakes", 1)["fake"]
    digits = F.regexp_replace("hit", r"\D", "")
    before = F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 10, F.lit(0)))  # a phone's country code stays
    new = (
        F.when(F.col("kind") == "phone", _poured(F.col("hit"), F.concat(before, fake)))
        .when(F.col("kind").isin("card", "ssn", "iban"), _poured(F.col("hit"), fake))
        .when(F.col("kind") == "secret", F.concat(F.regexp_extract("hit", _SECRET_HEAD, 1), fake))
        .when(F.col("kind") == "name", F.concat(F.regexp_extract("hit", r"^(\S+ )", 1), F.array_join(F.transform("fakes", lambda x: x["fake"]), " ")))
        .otherwise(fake)
    )
    words = F.transform("fakes", lambda x: F.struct(x["canon"].alias("canon"), x["fake"].alias("fake")))
    return fakes.select("hit", new.alias("new"), F.when(F.col("kind") == "name", words).otherwise(F.array().cast("array<struct<canon:string,fake:string>>")).alias("tokens"))


def _mentions_replaced(gap: Column, names: Column) -> Column:
    """A stretch of text in which the words of ``names``, an array of (canon, fake), have given way to their surrogates, all at once."""
    words = F.array_distinct(F.transform(names, lambda x: x["canon"]))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    fake = lambda m: F.get(F.filter(names, lambda x: x["canon"] == m), F.lit(0))["fake"]

    def joined(p: Column) -> Column:
        new = F.transform(F.regexp_extract_all(gap, p, F.lit(0)), fake)
        return F.concat_ws("", F.flatten(F.zip_with(F.split(gap, p, -1), new, lambda g, n: F.array(g, n))))

    return F.when(F.size(names) > 0, F.get(F.transform(F.array(pattern), joined), F.lit(0))).otherwise(gap)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every detected entity in the text column replaced, plus ``n_replaced``.

    When the surrogates of a format are used up, they get longer (letters, syllables or digits), so every thing gets its own.
    The same thing gets the same surrogate in all documents, different things of a type different ones; numbers keep their
    separators, cards their first digit and Luhn validity, phones what precedes their last ten digits, names the
    gender of their title and their script. A name is found by its title; its words are then replaced wherever else they
    stand in the same document, with or without a title. Defined results: a null text stays null, a text without
    entities stays as it is byte by byte; rows equal in id and text get the same replacement; null
    ids are handled like others; an empty table gives no rows; other columns stay, whatever their names.
    """
    hits = write_table(find_entities(docs, id_col, text_col), "pii-hits")
    new = hits.join(write_table(replacements(hits, key), "pii-new"), "hit").select("id", "row", "pos", "new", "tokens").distinct()
    per_row = new.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "new", "tokens"))).alias("news"))  # the entities of one text
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("news", lambda x: x["tokens"]))))
    per_row = per_row.select(F.col("id").alias("hit_id"), F.col("row").alias("hit_row"), F.transform("news", lambda x: x["new"]).alias("news"), names.alias("names"))
    inner = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*inner)
    id_, text = inner[docs.columns.index(id_col)], inner[docs.columns.index(text_col)]
    rows = rows.withColumn("row", F.xxhash64(F.col(text).cast("string")))
    rows = rows.join(per_row, rows[id_].eqNullSafe(per_row.hit_id) & (rows["row"] == per_row.hit_row), "left")
    gaps = F.transform(F.split(F.col(text).cast("string"), ANY, -1), lambda g: _mentions_replaced(g, F.col("names")))
    joined = F.concat_ws("", F.flatten(F.zip_with(gaps, "news", lambda g, n: F.array(g, n))))
    new_text = F.when(F.col("news").isNull(), F.col(text)).otherwise(joined)
    out = rows.select(*[new_text.alias(c) if c == text else F.col(c) for c in inner], F.coalesce(F.size("news"), F.lit(0)).alias("n_replaced"))
    return out.toDF(*docs.columns, "n_replaced")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key="tessella")
