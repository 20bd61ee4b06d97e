import random

from loomstone.llm import names

VAR = "variant_id long, source_scope string, variant string, dob_hint string, first string, form string"
ENT = "entity_id long, source_scope string, entity_type string, first_name string, last_name string, dob string, variant string"


def entities(spark):
    return spark.createDataFrame(
        [
            (1, "s", "person", "Leopold", "Haverquist", "1970-02-03", ""),
            (2, "s", "person", "Leopold", "Haverquist", "1990-05-06", ""),
            (3, "s", "person", "Mirela", "Ostrander-Vale", None, ""),
            (4, "s", "organization", None, "Northern Brackwell Records Institute GmbH", None, ""),
            (5, "t", "person", "Mirela", "Ostrander-Vale", "1980-01-01", ""),
            (6, "s", "person", None, None, None, ""),
            (7, None, "person", "No", "Scope", None, ""),
        ],
        ENT,
    )


def test_links(spark):
    cases = [
        ("Haverquist, Leopold", "1970-02-03", 1),
        ("POLDI HAVREQUIST", "06.05.1990", 2),
        ("Leopold Haverquist", None, None),  # a namesake
        ("Leopold Haverquist", "1950", None),
        ("m. ostrander-vale", None, 3),
        ("MirelaOstranderVale", None, 3),
        ("Vale Ostrander, Mirela", None, None),
        ("Brackwell Records Inst., Northern", None, 4),
        ("The Northern Brackwel Records Institute", None, 4),
        ("N.B.R.I.", None, 4),
        ("Somebody Else", None, None),
        ("", None, None),
        (None, None, None),
        ("x" * 5000, None, None),
    ]
    rows = [(i, "s", v, h, "clash", "clash") for i, (v, h, _) in enumerate(cases)] + [(99, None, "Leopold Haverquist", None, "", ""), (0, "s", cases[0][0], cases[0][1], "", "")]
    got = {x.variant_id: x.entity_id for x in names.link_names(spark.createDataFrame(rows, VAR), entities(spark)).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(cases) if e}


def test_radius_join_is_exact(spark):
    r = random.Random(1)
    make = lambda: "".join(r.choice("abc") for _ in range(r.randrange(3, 9)))
    left = [("s", "fam", make()) for _ in range(80)]
    right = [("s", "fam", make()) for _ in range(120)] + [("t", "fam", "abc")]
    got = names.radius_join(spark.createDataFrame(left, "scope string, kind string, form string"), spark.createDataFrame(right, "scope string, kind string, form string"))
    reach = lambda q: 1 if len(q) <= 4 else 2 if len(q) <= 6 else 3
    want = {(q, e, names.edits(q, e)) for _, _, q in left for s, _, e in right if s == "s" and names.edits(q, e) <= reach(q)}
    rows = got.collect()
    assert {(x.q, x.e, x.dist) for x in rows} == want and len(rows) == len(want)


def test_many_namesakes_are_told_by_their_dates(spark):
    born = [f"{1950 + k // 28}-{1 + k % 12:02d}-{1 + k % 28:02d}" for k in range(300)]
    people = [(k, "s", "person", "Leopold", "Haverquist", born[k] if k else None, "") for k in range(300)]
    typed = [(k, "s", "Haverquist, Leopold", born[k], "", "") for k in range(1, 300)] + [(900, "s", "Leopold Haverquist", None, "", ""), (901, "s", "Leopold Haverquist", born[5][:4], "", "")]
    got = {x.variant_id: x.entity_id for x in names.link_names(spark.createDataFrame(typed, VAR), spark.createDataFrame(people, ENT)).collect()}
    once = {k for k in range(1, 300) if born.count(born[k]) == 1}
    assert {k: k for k in once} == got


def test_family_names_of_many_parts_and_long_names():
    forms = names.variant_forms("Ana Maria de la Cruz y Vega", 40, 5)
    assert ("fam", "delacruzyvega", "ana") in forms and ("fam", "mariadelacruzyvega", "ana") in forms
    assert ("fam", "cruzyvega", "ana") in forms and ("fam", "vega", "ana") in forms
    assert len(names.variant_forms("word " * 20_000, 40, 5)) < 50


def test_empty(spark):
    none = entities(spark).where("false")
    v = spark.createDataFrame([(1, "s", "A B", None, "", "")], VAR)
    assert names.link_names(v, none).count() == 0
    assert names.link_names(v.where("false"), entities(spark)).count() == 0
