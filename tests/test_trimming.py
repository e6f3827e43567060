"""Planted sections of every kind against sequential versions."""

import re

from pyspark.sql import functions as F

from tessella.operators import trimming as T
from tessella.operators.sections import GROUP_WORDS

DOSING = [
    "Děti nesmí užívat.\nDospělí: 5 mg denně\n## Zvláštní populace\nméně",
    "Dávkování\n## Starší pacienti\n2 tablety\n## Děti\n1 tableta",
    "úvod\n| a | b |\n|---|---|\n| 75-200 | x |\nDěti od 2 let\nvíce",
    "## Porucha funkce jater\n| a | b |\n|---|---|\n| 1 | x |",
    "V tenké vrstvě. " * 20 + "\nPediatrická populace\nnic",
    "krátké\nPediatrická populace\nnic", "  bez konce 5 mg  ", "", "\n\n",
]
ADVERSE = [
    "Úvod o studiích.\n\n| časté | bolest |\n|---|---|\n## Popis vybraných účinků\nx",
    "Definice: velmi časté.\nPoruchy imunitního systému\n\nNení známo: hypersenzitivita\nČasté: svědění\nPediatrická populace\ny",
    "Věta, která končí tečkou.\nVzácné: a\nb", "Časté: a\nMéně časté: b\nHlášení podezření na nežádoucí účinky\nz", "nic\nstarší\n| a |",
    "jen próza\nbez struktury", "# Nadpis\ntext\nČasté: x", "x" * 95 + "\nčasté : y", "Časté: q\nvzácné\n: r", "", "Další informace", "\n\n Vzácné: tady",
]
LISTED = [
    "## Dospělí\n- vředy\n- reflux; pálení žáhy\n## Pediatrické použití:\nDěti od 1 roku a s hmotností >= 10 kg\n- reflux\n\n## Léčba bez porady\n- jiné",
    "bolest; horečka", "# Starší pacienti\n\n* jedno\nDospělí a další věta. Konec\nDospívající od 12 let\ndvě", "Děti od 2 let\n- bez nadpisu", "", "## Jiné\nx\n## Děti\ny",
]


def plain_dosing(text):
    table = lambda t: sum(x.lstrip().startswith("|") for x in t.split("\n")) >= 3
    lines = text.split("\n")
    cuts = ["\n".join(lines[:i]).strip() for i, x in enumerate(lines) if re.match(rf"\s*#{{0,6}}\s*({T.DOSING_ENDS})", x, re.I)]
    for ok in (lambda c: (not table(text) or table(c)) and re.search(T.DOSE[5:], c, re.I), table if table(text) else lambda c: len(c) >= 250):
        for c in cuts:
            if ok(c):
                return c
    return text.strip()


def plain_adverse(text):
    kept = []
    for x in text.split("\n"):
        if re.match(rf"\s*#{{0,6}}\s*({T.ADVERSE_ENDS})", x, re.I):
            break
        kept.append(x)
    frequency = lambda x: re.match(T.FREQUENCY_LINE[5:], x.strip(), re.I)
    for i, x in enumerate(kept):
        if x.strip()[:1] in ("|", "#") and x.strip() or frequency(x):
            if frequency(x):
                j = i - 1
                while j >= 0 and not kept[j].strip():
                    j -= 1
                if j >= 0 and len(kept[j].strip()) <= 90 and not kept[j].strip().endswith(".") and not frequency(kept[j]):
                    i = j
            kept = kept[i:]
            break
    return "\n".join(kept).strip()


def plain_listed(text):
    group, out = None, []
    for x in re.sub(r"\s*;\s*", "\n", text.strip()).split("\n"):
        s = x.strip()
        if s.startswith("#"):
            title = re.sub(r"\s*:$", "", s.lstrip("#").strip())
            group = title if re.search(GROUP_WORDS, title, re.I) else None
            out.append(x)
        elif group is not None and s and re.match(T.REFINEMENT[5:], s.lstrip("-* "), re.I):
            group = s.lstrip("-* ")
            out.append(x)
        else:
            out.append(f"[{group}] {s}" if group is not None and s else x)
    return "\n".join(out)


def test_cores_equal_sequential_versions(spark):
    rows = [*((t, "dosing", plain_dosing(t)) for t in DOSING), *((t, "adverse", plain_adverse(t)) for t in ADVERSE), *((t, k, plain_listed(t)) for t in LISTED for k in ("indication", "contraindication"))]
    rows += [("  a \n", "other", "a"), (None, "dosing", None), (None, "adverse", None), (None, "indication", None)]
    got = spark.createDataFrame(rows, "t string, s string, want string").withColumn("got", T.core(F.col("t"), F.col("s"), trim_dosing=True)).collect()
    for r in got:
        assert r.got == r.want, (r.s, r.t)
    whole = spark.createDataFrame([(t,) for t in DOSING], "t string").select("t", T.core(F.col("t"), F.lit("dosing")).alias("got")).collect()
    assert all(r.got == r.t.strip() for r in whole)  # off unless asked for


def test_cores_by_hand(spark):
    got = spark.createDataFrame([(ADVERSE[1], "adverse"), (LISTED[0], "indication"), (DOSING[1], "dosing")], "t string, s string").select(T.core(F.col("t"), F.col("s"), True).alias("c")).collect()
    assert got[0].c == "Poruchy imunitního systému\n\nNení známo: hypersenzitivita\nČasté: svědění"
    assert "[Dospělí] - pálení žáhy" not in got[1].c and "[Dospělí] pálení žáhy" in got[1].c and "[Děti od 1 roku a s hmotností >= 10 kg] - reflux" in got[1].c and "\n- jiné" in got[1].c
    assert got[2].c == "Dávkování\n## Starší pacienti\n2 tablety"


def test_cores_of_documents(spark):
    import zlib

    import __spark_entry__ as entry
    from tessella.plans.documents import sections_to_trim

    sf = "/root/testdata/sf0.001"
    plain = {"adverse": plain_adverse, "dosing": plain_dosing, "indication": plain_listed, "other": str.strip}
    want = set()
    for r in sections_to_trim(spark, sf).collect():
        core = plain[r.section](r.text) if r.text is not None else None
        want.add((r.doc_id, r.section, None if core is None else len(core), None if core is None else zlib.crc32(core.encode())))
    assert set(map(tuple, entry.queries()["section_core"](spark, sf).collect())) == want


def test_refined_groups_of_lines(spark):
    from tessella.operators import sections as S

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(LISTED)], "id int, text string")
    got = {}
    for r in S.fill_group_headings(S.lines_of(docs, "id", "text"), "id", refine=T.REFINEMENT).orderBy("id", "pos").collect():
        if not r.is_heading and r.line.strip():
            got.setdefault(r.id, []).append(f"[{r.group}] {r.line.strip()}" if r.group else r.line.strip())
    for i, t in enumerate(LISTED):
        refined = {x.lstrip("-* ") for x in t.split("\n")}
        plain = [x.strip() for x in plain_listed(t.replace(";", ",")).split("\n") if x.strip() and not x.strip().startswith("#")]
        want = [x for x in plain if x.startswith("[") or x.lstrip("-* ") not in refined or not re.match(T.REFINEMENT[5:], x.lstrip("-* "), re.I) or "#" not in t.split(x)[0]]
        assert [x.replace(";", ",") for x in got.get(i, [])] == want


def test_forms_by_route(spark):
    from tessella.operators.ages import other_form

    rows = [("podání i. v.", "TBL NOB", True), ("podání i.m.", "INJ SOL", False), ("na kůži", "POR SOL", True), ("sirup", "POR SOL", False), ("prášek", "POR PLV SUS", False), ("iv", "TBL", False)]
    got = spark.createDataFrame(rows, "t string, f string, want boolean").select("want", other_form(F.col("t"), F.col("f")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
