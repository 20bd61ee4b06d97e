"""Variant spellings of names typed by people (problem 5).

Names become forms: a person's family name, the rarest word of an
organization's name, an acronym.  Within a scope the entities' forms are
assigned to their nearest pivot (of about sqrt(n) for n forms, so that pivots
and cells grow alike) and, there, to the ring of their distance.  By the triangle inequality a form within radius r
of a typed form q lies in rings k with |d(q, pivot) - k| <= r only, to which q
is replicated; inside each cell an exact radius join runs with the Levenshtein
distance, a true metric.  What remains (given name, initials, nicknames, other
words) is checked name by name, once for all who bear it and all variants
typed so; the birth date is looked up then, under its year, month and day, where
of any number of namesakes the first and the last one tell what is ambiguous.
The cheapest entity is taken if no other costs about the same.

Defined results: blank names and rows without a scope link to nothing; a
variant with two equally good entities links to none; a birth date that
contradicts rules an entity out; repeated rows give one link; empty tables
give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.session import materialize

#: Edits that any form may have at most.
MOST_EDITS = 4

# Forms of address, words without weight, legal forms.
TITLES = set("mr mrs ms miss mx dr prof professor sir dame herr frau sr sra señor señora mme mlle jr snr rev hon".split())
SMALL = set("the of and for de des der die das la le et y & a an".split())
LEGAL = set("ltd limited inc incorporated llc gmbh ag plc corp sa srl kg ev trust".split())
# Short forms of given names.
NICKNAMES = """
alexander: alex al sandy sasha sandro lex xander alec; anastasia: nastya ana stasia tasia asya stacy stacey; bartholomew: bart barty tolly batt
christopher: chris kit topher kris; dolores: lola lolita dolly; dmitri: dima mitya; edward: ed eddie ned ted teddy
elizabeth: liz beth betty eliza lizzie bess libby elsie; francisco: paco pancho frank cisco kiko fran; frederick: fred freddy fritz rick freddie
gabriela: gabi gaby bri; giuseppe: beppe pino peppe joe; guillermo: memo guille willy gil; henrietta: etta hettie hetty harriet
ignacio: nacho iggy; jacqueline: jackie jacqui; johannes: hans jo johann hannes jan; katherine: kate kathy kat katie kit kay
leonardo: leo nardo lenny; leopold: leo poldi; lucía: lucy luz; margaret: peggy meg maggie greta rita madge; mikhail: misha mike
nikolai: kolya nick niko; ottoline: otto lina ottie; patricia: pat trish tricia patty; philippa: pippa; quentin: quin quent
richard: dick rick rich richie ricky; robert: bob rob bobby bert robin; rosalind: roz linda rosa ros; susannah: sue susie zanna susan
theodora: thea dora teddy theo; tomas: tom tommy; umberto: berto; valentina: val tina valya; vincenzo: enzo vince vinny
wilhelmina: willa mina minnie billie wilma; william: bill will liam billy willy; yevgenia: zhenya genya jenya; zachary: zach zack zak
zoë: zo; thomas: tom tommy; joseph: joe joey; michael: mike mick; james: jim jimmy jamie; john: jack johnny; charles: charlie chuck
""".replace("\n", ";")


def plain(s: str) -> str:
    """Lower case without marks; a digit inside a word becomes its look-alike."""
    s = s.lower().translate(str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "ı": "i", "’": "'"}))
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return re.sub(r"(?<=[a-z])[01345](?=[a-z])|(?<=[a-z])[01345]\b|\b[01345](?=[a-z]{2})", lambda m: "oleas"["01345".index(m[0])], s)


NICK: dict[str, set[str]] = {}
for _entry in NICKNAMES.split(";"):
    if ":" in _entry:
        _full, _short = _entry.split(":")
        for _name in _short.split():
            NICK.setdefault(_name, set()).add(plain(_full.strip()))


def letters(s: str) -> str:
    return re.sub(r"[^a-z]", "", plain(s))


def edits(a: str, b: str, most: int = 4) -> int:
    """Levenshtein distance, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def swaps(a: str, b: str) -> bool:
    """Whether one swap of neighbours turns a into b."""
    if len(a) != len(b):
        return False
    at = [i for i in range(len(a)) if a[i] != b[i]]
    return len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]


def typos(a: str, b: str, most: int = 3) -> float:
    return 1.0 if swaps(a, b) else float(edits(a, b, most))


def words(s: str) -> list[str]:
    return [w for w in re.findall(r"[a-z']+", plain(s).replace("'", "")) if w]


def acronym(s: str) -> str | None:
    """The letters of an acronym such as ``C.F.E.D.`` or ``EWRA``."""
    t = s.strip().strip("()")
    if re.fullmatch(r"(?:[A-Za-z]\.\s?){3,7}|(?:[A-Z]\s?){3,7}", t):
        return re.sub(r"[^a-z]", "", t.lower())
    return None


def org_words(s: str) -> list[str]:
    return [w for w in words(s) if w not in SMALL and w not in LEGAL]


def variant_forms(variant: str, letters_most: int = 1 << 30, words_most: int = 1 << 30) -> list[tuple[str, str, str]]:
    """(kind, form, rest) readings of a typed name; those longer than any entity
    (of ``letters_most`` letters in a name, ``words_most`` words) are left out,
    as they can match none."""
    longest = letters_most + MOST_EDITS
    out: set[tuple[str, str, str]] = set()
    short = acronym(variant)
    if short:
        out.add(("acr", short, ""))
    own = org_words(variant)
    if 3 <= len(own) <= words_most + 1:
        out |= {("org", w, " ".join(own)) for w in own if len(w) >= 4}
    text = re.sub(r"\s+", " ", variant).strip()
    tidy = lambda x: " ".join(w for w in x.replace(".", " ").split() if letters(w) and letters(w) not in TITLES)
    if "," in text:
        family, given = text.split(",", 1)
        if letters(tidy(family)):
            out.add(("fam", letters(tidy(family)), " ".join(words(tidy(given))[:1])))
            return sorted(x for x in out if len(x[1]) <= longest)
    parts = [w for w in re.split(r"[\s.,_;/]+", text) if letters(w) and letters(w) not in TITLES]
    if len(parts) == 1:
        out.add(("fam", letters(parts[0]), ""))
        glued = letters(parts[0])  # both names run together, in either order
        for k in range(max(2, len(glued) - longest), min(len(glued) - 3, longest + 1)):
            out.add(("fam", glued[k:], glued[:k]))
            out.add(("fam", glued[:-k], glued[-k:]))
    one = [letters(p) for p in parts]
    sizes = [len(p) for p in one]
    ahead = first_word(parts[0]) if parts else ""
    behind, before = sum(sizes), 0
    for k in range(1, len(parts)):
        behind, before = behind - sizes[k - 1], before + sizes[k - 1]
        if behind <= longest:
            out.add(("fam", "".join(one[k:]), ahead))
        if before <= longest:
            out.add(("fam", "".join(one[:k]), first_word(parts[k])))
    if len(parts) == 3:  # a middle name or initial
        out.add(("fam", one[2], ahead))
        out.add(("fam", one[0], first_word(parts[1])))
    return sorted(x for x in out if x[1] and len(x[1]) <= longest)


def first_word(s: str) -> str:
    return next(iter(words(s)), "")


def radius(c: Column) -> Column:
    """Edits allowed for a form by its length; none for acronyms."""
    n = F.length(c)
    return F.when(F.col("kind") == "acr", 0).when(n <= 4, 1).when(n <= 6, 2).when(n <= 14, 3).otherwise(4)


def given_cost(typed: str, first: str) -> float | None:
    """Cost of ``typed`` as a form of the given name ``first``; None: it isn't."""
    a, b = letters(typed.split(" ")[0]) if typed else "", letters(first)
    if not a or not b:
        return 0.9
    if a == b:
        return 0.0
    if len(a) == 1:
        return 0.5 if b[0] == a else None
    full = NICK.get(a, set())
    if b in full:
        return 0.2
    near = typos(a, b, 2)
    if near <= (1 if min(len(a), len(b)) <= 3 else 2):
        return 0.5 * near
    for nick, names in NICK.items():
        if b in names and len(nick) >= 3 and len(a) >= 3 and typos(a, nick, 1) <= 1:
            return 0.8
    return None


def abbreviates(a: str, b: str) -> bool:
    """Whether ``a`` shortens ``b``: same first letter, letters in order."""
    if not a or a[0] != b[0] or len(a) >= len(b):
        return False
    rest = iter(b)
    return all(c in rest for c in a)


def org_cost(typed: str, name: str) -> float | None:
    """Cost of the words of ``typed`` as those of ``name``, in any order."""
    left, right = typed.split(), org_words(name)
    if abs(len(left) - len(right)) > 1 or not right:
        return None
    cost, free = 0.0, list(left)
    missing = 0
    for w in sorted(right, key=len, reverse=True):
        best = None
        for v in free:
            c = typos(v, w, 2) if len(w) > 3 or v == w else 3
            c = min(c, 0.3 if abbreviates(v, w) else 3)
            if c <= 2 and (best is None or c < best[0]):
                best = (c, v)
        if best is None:
            missing += 1
            continue
        cost += best[0] * 0.5
        free.remove(best[1])
    if missing + len(free) > 1 or missing > 1:
        return None
    return cost + missing * 1.0 + len(free) * 0.5


def date_parts(s: str | None) -> list[int]:
    """Year, month and day, as far as they are told."""
    parts = re.findall(r"\d+", s or "")
    if len(parts) == 3 and len(parts[2]) == 4:
        parts = parts[::-1]
    return [int(x) for x in parts]


#: Dates that say nothing: of an entity, and of a variant (any date agrees).
UNKNOWN, ANY = "?", "*"


def date_keys(dob: str | None) -> list[str]:
    """What a variant may say of this birth date."""
    parts = date_parts(dob)
    return [ANY, *("-".join(map(str, parts[:k])) for k in range(1, len(parts) + 1))] if parts else [UNKNOWN]


def date_asked(hint: str | None) -> str:
    return "-".join(map(str, date_parts(hint))) or ANY


def _variant_rows(letters_most: int, words_most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (i, s, date_asked(h), k, f, r)
                for i, s, v, h in zip(pdf["variant_id"], pdf["scope"], pdf["variant"], pdf["hint"])
                for k, f, r in variant_forms(v, letters_most, words_most)
            ]
            yield pd.DataFrame(rows, columns=["variant_id", "scope", "asked", "kind", "form", "rest"])

    return run


def _entity_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, s, t, first, last, dob in pdf[["entity_id", "scope", "type", "first", "last", "dob"]].itertuples(index=False):
            if t == "organization" or (not first and len(org_words(last)) >= 3):
                own = org_words(last)
                rows += [(i, s, dob, "word", w, "", last) for w in set(own)]
                long = [w for w in words(last) if w not in SMALL]
                rows += [(i, s, dob, "acr", "".join(w[0] for w in x), "", last) for x in {tuple(own), tuple(long)} if len(x) >= 3]
            elif letters(last):
                rows.append((i, s, dob, "fam", letters(last), first or "", last))
                # One half of a double name may stand for it.
                rows += [(i, s, dob, "fam", letters(x), first or "", last) for x in re.split(r"[-\s]+", last) if len(letters(x)) >= 5 and letters(x) != letters(last)]
        yield pd.DataFrame(rows, columns=["entity_id", "scope", "dob", "kind", "form", "first", "last"])


def entity_forms(entities: DataFrame) -> DataFrame:
    """(entity_id, scope, dob, kind, form, first, last): what is searched for."""
    rows = entities.select(
        F.col("entity_id").cast("long").alias("entity_id"), F.col("source_scope").alias("scope"), F.lower("entity_type").alias("type"),
        F.col("first_name").alias("first"), F.col("last_name").alias("last"), "dob",
    ).where("last is not null and scope is not null")
    schema = "entity_id long, scope string, dob string, kind string, form string, first string, last string"
    forms = materialize(rows.mapInPandas(_entity_rows, schema))
    # An organization is searched by the rarest of its words.
    counts = forms.where("kind = 'word'").groupBy("form").agg(F.count("*").alias("n"))
    rarest = (
        forms.where("kind = 'word'").join(counts, "form")
        .groupBy("entity_id", "scope", "dob", "last")
        .agg(F.min(F.struct("n", (-F.length("form")).alias("l"), "form")).alias("m"))
        .select("entity_id", "scope", "dob", F.lit("org").alias("kind"), F.col("m.form").alias("form"), F.lit("").alias("first"), "last")
    )
    return materialize(forms.where("kind != 'word'").unionByName(rarest).distinct())


def radius_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """(scope, kind, q, e, dist): all pairs of distinct forms of ``left`` (q) and
    ``right`` (e), both (scope, kind, form), within ``radius`` of q."""
    group = ["scope", "kind"]
    right = right.select(*group, "form").distinct()
    sizes = right.groupBy(*group).agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("form"), "form")).alias("m"))
    every = F.ceil(F.sqrt("n")).cast("long")
    pivots = (
        right.join(sizes, group)
        .where((F.pmod(F.xxhash64("form"), every) == 0) | (F.col("form") == F.col("m.form")))
        .groupBy(*group)
        .agg(F.sort_array(F.collect_set("form")).alias("pivots"))
    )
    away = F.transform("pivots", lambda p: F.levenshtein(F.col("form"), p))
    cells = (
        right.join(pivots, group)
        .withColumn("d", away)
        .withColumn("ring", F.array_min("d"))
        .withColumn("pivot", F.array_position("d", F.col("ring")).cast("int"))
        .select(*group, F.col("form").alias("e"), "pivot", "ring")
    )
    cells = materialize(cells)
    known = cells.groupBy(*group).agg(F.collect_set(F.struct("pivot", "ring")).alias("cells"))
    asked = (
        left.select(*group, "form").distinct()
        .withColumn("r", radius(F.col("form")))
        .join(pivots, group)
        .withColumn("d", away)
        .join(known, group)
        .withColumn("c", F.explode(F.filter("cells", lambda c: F.abs(F.element_at("d", c["pivot"]) - c["ring"]) <= F.col("r"))))
        .select(*group, F.col("form").alias("q"), "r", F.col("c.pivot").alias("pivot"), F.col("c.ring").alias("ring"))
    )
    near = asked.join(cells, [*group, "pivot", "ring"]).withColumn("dist", F.expr("levenshtein(q, e, r)"))
    return near.where("dist >= 0").select(*group, "q", "e", "dist")


def _dates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([(d, k) for d in pdf["dob"] for k in date_keys(d)], columns=["dob", "key"])


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Costs of typed names as entities' names: of the family and given name
    and of a part for the whole; those no date could save are left out."""
    for pdf in batches:
        out = []
        for scope, kind, q, rest, e, first, last in pdf.itertuples(index=False):
            if kind == "fam":
                given = given_cost(rest, first)
                if given is None:
                    continue
                family, part = typos(q, e, 4), 0.0 if e == letters(last) else 0.7
                if family + given + part <= 5.0:
                    out.append((scope, kind, q, rest, e, first, last, family, given, part))
            elif kind == "org":
                cost = org_cost(rest, last)
                if cost is not None:
                    out.append((scope, kind, q, rest, e, first, last, cost, 0.0, 0.0))
            else:
                out.append((scope, kind, q, rest, e, first, last, 1.0, 0.0, 0.0))
        yield pd.DataFrame(out, columns=["scope", "kind", "q", "rest", "e", "first", "last", "family", "given", "part"])


def _cost() -> Column:
    """Cost of a pair given its name's costs and what the date says (``date``);
    null where that is too much.  The less is known of a person, the fewer
    typos are borne."""
    n, known = F.length("e"), F.col("family") + F.col("given") + F.col("part")
    most = F.when(F.col("date") == 0, 4.0).otherwise(3.2) - F.when(n <= 6, 0.5).otherwise(0.0) + F.when(n >= 15, 1.0).otherwise(0.0)
    vague = (F.col("given") >= 0.5) & (F.col("date") >= 0.6) & ((F.col("family") > 2) | (F.col("given") > 1) | (F.col("part") > 0))
    return F.when((F.col("kind") != "fam") | (~vague & (known <= most)), known + F.col("date"))


def link_names(variants: DataFrame, entities: DataFrame) -> DataFrame:
    """(variant_id, entity_id, cost): the entity each variant means."""
    rows = variants.select(
        F.col("variant_id").cast("long").alias("id"), F.col("source_scope").alias("scope"), "variant", F.col("dob_hint").alias("hint")
    ).where("variant is not null and scope is not null")
    # Variants typed alike are judged once, under the least of their ids.
    typed = materialize(rows.groupBy("scope", "variant", "hint").agg(F.min("id").alias("variant_id")))
    known = entity_forms(entities)
    sizes = known.agg(F.max(F.greatest(F.length("form"), F.length("first"), F.length("last"))), F.max(F.size(F.split("last", " ")))).first()
    schema = "variant_id long, scope string, asked string, kind string, form string, rest string"
    asked = materialize(typed.mapInPandas(_variant_rows(sizes[0] or 0, sizes[1] or 0), schema)).withColumnRenamed("form", "q")
    known = known.withColumnRenamed("form", "e")
    near = radius_join(asked.withColumnRenamed("q", "form"), known.withColumnRenamed("e", "form")).select("scope", "kind", "q", "e")
    name, reading = ["scope", "kind", "e", "first", "last"], ["scope", "kind", "q", "rest"]
    pairs = near.join(asked.select(*reading).distinct(), ["scope", "kind", "q"]).join(known.select(*name).distinct(), ["scope", "kind", "e"])
    judged = pairs.select(*reading, "e", "first", "last").mapInPandas(_judge, "scope string, kind string, q string, rest string, e string, first string, last string, family double, given double, part double")
    # Who bears a name and was born then: the first and the last of them.
    known = known.withColumn("dob", F.coalesce("dob", F.lit("")))
    born = known.select("dob").distinct().mapInPandas(_dates, "dob string, key string")
    bearers = known.join(born, "dob")
    bearers = bearers.groupBy(*name, "key").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
    met = judged.join(asked, reading).withColumn("key", F.explode(F.array("asked", F.lit(UNKNOWN))))
    date = F.when(F.col("key").isin(UNKNOWN, ANY), 0.6).when(F.col("key").rlike("-.*-"), 0.0).otherwise(0.3)
    met = met.join(bearers, [*name, "key"]).withColumn("date", date).withColumn("cost", _cost()).where("cost is not null")
    costs = met.select("variant_id", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("entity_id"), "cost")
    best = costs.groupBy("variant_id", "entity_id").agg(F.min("cost").alias("cost"))
    order = Window.partitionBy("variant_id").orderBy("cost", "entity_id")
    ranked = best.withColumn("k", F.row_number().over(order)).withColumn("next", F.lead("cost").over(order))
    found = ranked.where("k = 1 and (next is null or next > cost + 0.15)").select("variant_id", "entity_id", "cost")
    found = typed.join(found, "variant_id").select("scope", "variant", F.coalesce("hint", F.lit("")).alias("h"), F.col("hint").isNull().alias("no"), "entity_id", "cost")
    every = rows.select(F.col("id").alias("variant_id"), "scope", "variant", F.coalesce("hint", F.lit("")).alias("h"), F.col("hint").isNull().alias("no")).distinct()
    return every.join(found, ["scope", "variant", "h", "no"]).select("variant_id", "entity_id", "cost")
