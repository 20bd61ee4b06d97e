"""Matching works and sightings without keys (problem 1).

Candidate pairs agree in the author's name but for one letter on either side
and share a title word's head in about the same year, or agree in all their title
words' heads but one.  Pairs whose authors contradict each other are no
candidates; all others get log-odds from title, author, year and venue, rivals (a sequel, an edition, a
sister study) low ones.

Loopy belief propagation runs over this graph.  A record (the sightings of one
source that read alike) reports one work or none; a source reports a work once,
each pair of its records for one work costs ``price``, which is estimated from
how often records without a rival share a work.  Messages are kept in log space
and damped, and exchanged through joins until they settle; the marginals are
the confidences.

Defined results: missing fields are no evidence either way; repeated sightings count once;
empty tables give an empty result; names and titles of any length are compared
whole; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.names import plain, typos
from loomstone.session import materialize

#: Change of a message (log) that counts as none, the part of the old message
#: that is kept, and the rounds after which messages that still move are told.
SETTLED, DAMPING, ROUNDS = 1e-3, 0.3, 100
#: Log-odds that a first and any further contradicting title word take, and the
#: least of an edge.
APART, FURTHER, LEAST = 8.0, 1.0, -14.0
#: Log-odds that years more than one apart take.
YEARS = 8.0
#: Greatest price of a second record of one source for a work.
DEAREST = 6.0

# Words without weight, notes that make no other work, venues that say nothing.
SMALL = set("a an the of for in on at to by and with w from under over through between after without beyond via de la der die das und et y".split())
NOTES = ("preprint", "extended", "abstract", "draft", "poster", "demo")
VAGUE = ("preprint", "preprint server", "tech report", "technical report", "unpublished manuscript", "manuscript", "working paper", "arxiv", "n a", "unknown", "misc")
PARTICLES = set("de la del der den van von al el bin ibn da dos di du le o mc st".split())


@lru_cache(maxsize=100_000)
def tidy(s: str) -> str:
    return plain(s.replace("&", " and ").replace("w/out", "without").replace("w/", "with ").replace("’", "'"))


@lru_cache(maxsize=100_000)
def title_words(s: str) -> tuple[str, ...]:
    """Content words of a title in order."""
    return tuple(w for w in re.findall(r"[a-z0-9]+", tidy(s)) if w not in SMALL)


@lru_cache(maxsize=100_000)
def says_nothing(v: str) -> bool:
    """Whether a word of a seen title is a note, a typo in a word without weight
    or a letter left over."""
    if any(typos(v, n, 3) <= (2 if len(n) > 5 else 1) for n in NOTES):
        return True
    if v.isdigit():
        return False
    return len(v) <= 1 or any(typos(v, n, 2) <= (1 if len(n) < 6 else 2) for n in SMALL if len(n) >= 2)


close = lru_cache(maxsize=1_000_000)(typos)


@lru_cache(maxsize=100_000)
def author_key(s: str | None) -> str:
    """The letters of the family names, without initials and particles."""
    if not s:
        return ""
    parts = [w for w in re.findall(r"[a-z]+", tidy(s).replace("'", "")) if len(w) > 2 and w not in PARTICLES]
    return "".join(parts)


def year_of(s: str | None) -> int | None:
    m = re.search(r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)", s or "")
    return int(m[1]) if m else None


_BASE, _MOD = 0x1F3B5A79, (1 << 61) - 1


def less_one(s: str) -> list[int]:
    """Hashes of ``s`` and of all strings that lack one of its letters."""
    n = len(s)
    power, ahead = [1] * (n + 1), [0] * (n + 1)
    for i, c in enumerate(s):
        power[i + 1] = power[i] * _BASE % _MOD
        ahead[i + 1] = (ahead[i] * _BASE + ord(c)) % _MOD
    out, behind = {ahead[n] * 1009 + n}, 0
    for i in range(n - 1, -1, -1):
        out.add((ahead[i] * power[n - 1 - i] + behind) % _MOD * 1009 + n - 1)
        behind = (behind + ord(s[i]) * power[n - 1 - i]) % _MOD
    return sorted(x % (1 << 63) for x in out)


def heads_of(title: str | None) -> list[int]:
    """Hashes of the first letters of a title's words, notes aside."""
    heads = {w[:3] for w in title_words(title or "") if not any(w.startswith(n[:4]) for n in NOTES)}
    return [xxhash.xxh64_intdigest(h) >> 1 for h in sorted(heads)]


def title_keys(heads: list[int]) -> list[int]:
    """Hashes of a title's heads together and less one of them."""
    total = sum(heads)
    return sorted({x % (1 << 63) for x in (total, *(total - h for h in heads))}) if len(heads) >= 3 else []


def _prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        heads = [heads_of(t) for t in pdf["title"]]
        yield pdf.assign(who=[author_key(a) for a in pdf["author"]], y=pd.array([year_of(y) for y in pdf["year"]], dtype="Int32"), heads=heads, keys=[title_keys(h) for h in heads])


def _spellings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([(w, f) for w in pdf["who"] for f in less_one(w)], columns=["who", "form"])


def abbreviates(a: str, b: str) -> bool:
    if len(a) < 2 or len(a) >= len(b) or a[0] != b[0]:
        return False
    rest = iter(b)
    return all(c in rest for c in a)


@lru_cache(maxsize=1_000_000)
def word_cost(a: str, b: str) -> float | None:
    if a == b:
        return 0.0
    if a[:1].isdigit() or b[:1].isdigit():
        return None
    n = min(len(a), len(b))
    d = typos(a, b, 3)
    if d <= (0 if n <= 2 else 1 if n <= 5 else 2 if n <= 8 else 3):
        return 0.4 * d
    if abbreviates(a, b) and len(a) <= 6 and (b.startswith(a) or len(a) <= 5):
        return 0.4
    return None


def title_cost(work: str, seen: str) -> tuple[float, int]:
    """(cost, apart): the cost of ``seen`` as a way to write the title ``work``
    and the number of words that tell another work."""
    cut = bool(re.search(r"(?:…|\.\.\.)", seen))
    right, left = title_words(work), title_words(seen)
    if not right or not left:
        return 0.0, 1
    # A last word that only begins one of the work's: the title was cut there.
    cut = cut or (left[-1] not in right and any(w.startswith(left[-1]) for w in right) and len(left) >= 3 and not seen.rstrip().endswith("."))
    tail = re.sub(r"^[^:]*:", "", work) if ":" in work else ""
    sub = set(title_words(tail)) if len(title_words(work.split(":")[0])) > 1 else set()
    if work.count(":") > 1:
        sub = set(title_words(work.rsplit(":", 1)[1]))
    free = list(left)
    cost, missing = 0.0, []
    pending = []
    for w in right:  # exact words first
        if w in free:
            free.remove(w)
        else:
            pending.append(w)
    for w in pending:
        best = None
        for v in free:
            c = word_cost(v, w)
            if c is None and cut and v == left[-1] and w.startswith(v):
                c = 0.2
            if c is not None and (best is None or c < best[0]):
                best = (c, v)
        if best is None:
            missing.append(w)
        else:
            cost += best[0]
            free.remove(best[1])
    free = [v for v in free if not says_nothing(v)]
    if cut and free and len(free) == 1 and len(free[0]) <= 3:
        free = []
    apart = len(free)
    if not missing:
        return cost, apart
    if cut:
        return cost + 0.5 + 0.3 * len(missing), apart + (len(missing) > len(right) * 0.6)
    told = sum(w in ("part", "two", "ii", "iii", "revisited", "edition") for w in missing)
    if not told and set(missing) <= sub and len(right) - len(missing) >= 2:
        return cost + 0.8, apart
    rest = len(missing) - told
    if rest and not (rest <= 2 and len(right) >= 2 * rest + 1):
        apart += rest - (2 if len(right) >= 5 else 0)
    return cost + 1.3 * rest, apart + told


@lru_cache(maxsize=500_000)
def venue_cost(a: str | None, b: str | None) -> float:
    """Evidence of two venues: for, against or (little said) neither."""
    x, y = (" ".join(re.findall(r"[a-z0-9]+", tidy(v or ""))) for v in (a, b))
    if not x or not y or any(typos(v, n, 2) <= 2 for v in (x, y) for n in VAGUE if abs(len(v) - len(n)) <= 2):
        return 0.0
    p, q = ([w for w in v.split() if w not in SMALL and w not in ("proc", "proceedings", "meeting", "mtg")] for v in (x, y))
    if not p or not q:
        return 0.0
    if p == q or typos(x, y, 3) <= 3 and min(len(x), len(y)) > 6:
        return 1.2
    if len(p) > len(q):
        p, q = q, p
    heads = "".join(w[0] for w in q)
    if len(p) == 1 and (typos(p[0], heads, 1) <= 1 or p[0] in heads or p[0] == "".join(w[0] for w in y.split()) or p[0] == "".join(w[0] for w in x.split())):
        return 1.0
    hits = sum(any(word_cost(v, w) is not None for w in q) for v in p)
    return 1.0 if hits >= 0.7 * len(p) and hits >= 2 else -0.8


def log_odds(work: tuple, seen: tuple) -> float | None:
    """(title, author, year, venue) of a work and a sighting -> log-odds; None
    if the authors contradict each other."""
    total = 1.0
    x, y = year_of(work[2]), year_of(seen[2])
    if x is not None and y is not None:
        total += 1.5 if x == y else 0.2 if abs(x - y) == 1 else -YEARS
    a, b = author_key(work[1]), author_key(seen[1])
    if a and b:
        d = 0.0 if a == b else close(a, b, 3)
        if d <= 2 and min(len(a), len(b)) > 3 or d == 0:
            total += 3.0 - 0.8 * d
        elif d <= 3 and min(len(a), len(b)) >= 10:
            total += 0.3
        elif min(len(a), len(b)) >= 5 and (a.startswith(b) or b.startswith(a) or a.endswith(b) or b.endswith(a)):
            total += 1.5
        else:
            return None
    cost, apart = title_cost(work[0] or "", seen[0] or "")
    return total - 1.2 * cost - (APART + FURTHER * (apart - 1) if apart else 0.0) + venue_cost(work[3], seen[3])


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r, source, w, *f in pdf.itertuples(index=False):
            odds = log_odds(tuple(f[:4]), tuple(f[4:]))
            if odds is not None and odds >= LEAST:
                out.append((r, source, w, odds))
        yield pd.DataFrame(out, columns=["r", "source", "w", "odds"])


def records(sightings: DataFrame) -> DataFrame:
    """(sighting_id, r, source, title, author, year, venue): ``r`` is the least
    id of the source's sightings that read alike."""
    rows = sightings.select(
        F.col("sighting_id").cast("long").alias("sighting_id"), F.coalesce("source_name", F.lit("")).alias("source"), "title", F.col("first_author_last").alias("author"), "year", "venue"
    ).groupBy("sighting_id").agg(F.min(F.struct("source", "title", "author", "year", "venue")).alias("f")).select("sighting_id", "f.*")
    alike = [F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\W+", " ")) for c in ("title", "author", "year", "venue")]
    first = rows.groupBy("source", F.xxhash64(*alike).alias("_h")).agg(F.min("sighting_id").alias("r"))
    return rows.withColumn("_h", F.xxhash64(*alike)).join(first, ["source", "_h"]).drop("_h")


def _may_agree(left: str, right: str) -> Column:
    """Whether two author keys contradict each other, just as ``log_odds`` says."""
    a, b = F.col(left), F.col(right)
    part = (F.least(F.length(a), F.length(b)) >= 5) & (a.startswith(b) | b.startswith(a) | a.endswith(b) | b.endswith(a))
    return (a == "") | (b == "") | (F.levenshtein(a, b, 3) >= 0) | part


def candidate_pairs(seen: DataFrame, own: DataFrame) -> DataFrame:
    """(r, w): the pairs that are compared; ``seen`` and ``own`` have who, y,
    heads and keys."""
    spelt = lambda df: df.select("who").where("who != ''").distinct().mapInPandas(_spellings, "who string, form long")
    people = spelt(seen).join(spelt(own).withColumnRenamed("who", "known"), "form").select("who", "known").distinct()
    near = F.col("y").isNull() | F.col("w_y").isNull() | (F.abs(F.col("y") - F.col("w_y")) <= 1)
    works = own.select(F.col("id").alias("w"), F.col("who").alias("known"), F.col("y").alias("w_y"), "heads", "keys")
    # Authors are matched once for each spelling, not for each record.
    asked = seen.select(F.col("id").alias("r"), "who", "y", F.explode("heads").alias("head")).join(people, "who")
    by_author = asked.join(works.select("w", "known", "w_y", F.explode("heads").alias("head")), ["known", "head"]).where(near).select("r", "w")
    asked = seen.select(F.col("id").alias("r"), "who", "y", F.explode("keys").alias("key"))
    by_title = asked.join(works.select("w", "known", F.explode("keys").alias("key")), "key").where(_may_agree("who", "known")).select("r", "w")
    return by_author.unionByName(by_title).distinct()


def candidate_edges(works: DataFrame, seen: DataFrame) -> DataFrame:
    """(r, source, w, odds): the candidate graph over ``records``."""
    fields = ["title", "author", "year", "venue"]
    own = works.select(F.col("entity_id").cast("long").alias("id"), "title", F.col("first_author_last").alias("author"), "year", "venue")
    own = own.groupBy("id").agg(F.min(F.struct(*fields)).alias("f")).select("id", F.lit("").alias("source"), "f.*")
    seen = seen.where("sighting_id = r").select(F.col("r").alias("id"), "source", *fields)
    schema = "id long, source string, title string, author string, year string, venue string, who string, y int, heads array<long>, keys array<long>"
    own, seen = (materialize(df.mapInPandas(_prepare, schema)) for df in (own, seen))
    rows = (
        candidate_pairs(seen, own)
        .join(seen.select(F.col("id").alias("r"), "source", *[F.col(c).alias(f"s_{c}") for c in fields]), "r")
        .join(own.select(F.col("id").alias("w"), *[F.col(c).alias(f"w_{c}") for c in fields]), "w")
        .select("r", "source", "w", *[f"w_{c}" for c in fields], *[f"s_{c}" for c in fields])
    )
    return materialize(rows.mapInPandas(_score, "r long, source string, w long, odds double"))


def second_price(edges: DataFrame, works: int) -> float:
    """What a second record of one source for one work costs: by how much the
    log-odds of a second report are below those of a first, counted over
    records with one good edge and ``works`` times the number of sources."""
    single = edges.where("odds > 0").groupBy("r").agg(F.count("*").alias("n"), F.first("source").alias("source"), F.first("w").alias("w")).where("n = 1")
    pairs = single.groupBy("source", "w").agg(F.count("*").alias("n"))
    many, once, sources = pairs.agg(F.sum((F.col("n") > 1).cast("long")), F.count("*"), F.countDistinct("source")).first()
    logit = lambda a, b: math.log((a + 0.5) / (max(b - a, 0) + 0.5))
    return min(DEAREST, max(0.0, logit(once, max(works, 1) * max(sources, 1)) - logit(many or 0, once)))


def propagate(edges: DataFrame, price: float = DEAREST) -> DataFrame:
    """(r, w, belief): marginal probabilities by loopy belief propagation.

    An edge's belief is its odds and the factor's message ``nu`` against the
    record's other edges and none.  The one-to-one factor of a (work, source)
    multiplies exp(-price) once two of its records claim the work; its messages
    follow from the chances that none and that one of the others does."""
    discount = math.exp(-price)
    shared = edges.groupBy("source", "w").agg(F.count("*").alias("n")).where("n > 1").select("source", "w", F.lit(True).alias("shared"))
    state = materialize(edges.join(shared, ["source", "w"], "left").select("r", "source", "w", "odds", F.coalesce("shared", F.lit(False)).alias("shared"), F.lit(0.0).alias("nu")))
    # A record without a shared work gets no message that could change.
    moving = state.where("shared").select("r").distinct()
    rest, state = state.join(moving, "r", "left_anti"), materialize(state.join(moving, "r", "left_semi"))
    for k in range(ROUNDS):
        total = state.groupBy("r").agg(F.sum(F.exp(F.col("odds") + F.col("nu"))).alias("all"))
        others = F.greatest(F.lit(0.0), F.col("all") - F.exp(F.col("odds") + F.col("nu")))
        told = state.join(total, "r").withColumn("mu", F.least(F.lit(1 - 1e-9), F.exp("odds") / (1 + others + F.exp("odds"))))
        none, ratio = F.log1p(-F.col("mu")), F.col("mu") / (1 - F.col("mu"))
        sums = told.where("shared").groupBy("source", "w").agg(F.sum(none).alias("none"), F.sum(ratio).alias("ratio"))
        told = told.join(sums, ["source", "w"], "left")
        q0 = F.exp(F.least(F.lit(0.0), F.col("none") - none))
        q1 = F.least(1 - q0, q0 * F.greatest(F.lit(0.0), F.col("ratio") - ratio))
        fresh = F.log(q0 + (1 - q0) * discount) - F.log(q0 + q1 + (1 - q0 - q1) * discount)
        fresh = F.when(F.col("shared"), DAMPING * F.col("nu") + (1 - DAMPING) * fresh).otherwise(0.0)
        state = materialize(told.select("r", "source", "w", "odds", "shared", fresh.alias("nu"), F.abs(fresh - F.col("nu")).alias("moved")))
        moved = state.agg(F.max("moved")).first()[0]
        state = state.drop("moved")
        if moved is None or moved < SETTLED:
            break
    else:
        warnings.warn(f"messages still move by {moved:.3g} after {ROUNDS} rounds", stacklevel=2)
    state = state.unionByName(rest)
    total = state.groupBy("r").agg(F.sum(F.exp(F.col("odds") + F.col("nu"))).alias("all"))
    return state.join(total, "r").select("r", "w", (F.exp(F.col("odds") + F.col("nu")) / (1 + F.col("all"))).alias("belief"))


def decided(beliefs: DataFrame) -> DataFrame:
    """(r, entity_id, confidence): the likeliest work of each record, or none."""
    best = beliefs.groupBy("r").agg(F.max(F.struct("belief", (-F.col("w")).alias("w"))).alias("b"), F.sum("belief").alias("any"))
    found = F.col("b.belief") >= F.greatest(F.lit(0.5), 1 - F.col("any"))
    return best.select("r", F.when(found, -F.col("b.w")).alias("entity_id"), F.when(found, F.col("b.belief")).otherwise(1 - F.col("any")).alias("confidence"))


def match(works: DataFrame, sightings: DataFrame) -> DataFrame:
    """(sighting_id, entity_id, confidence): every sighting with the work it
    reports (null if none) and the marginal probability of that."""
    seen = materialize(records(sightings))
    edges = candidate_edges(works, seen)
    found = decided(propagate(edges, second_price(edges, works.count())))
    rows = seen.select("sighting_id", "r").join(found, "r", "left")
    return rows.select("sighting_id", "entity_id", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def rivalry(works: DataFrame, sightings: DataFrame) -> DataFrame:
    """One row: records with edges, edges, records with several edges, the
    price, and decisions that propagation changed."""
    edges = candidate_edges(works, materialize(records(sightings)))
    alone = decided(propagate(edges, 0.0)).select("r", F.col("entity_id").alias("before"))
    price = second_price(edges, works.count())
    both = alone.join(decided(propagate(edges, price)), "r")
    sizes = edges.groupBy("r").agg(F.count("*").alias("n"), F.sum((F.col("odds") > 0).cast("long")).alias("good"))
    rows = both.join(sizes, "r").agg(
        F.count("*").alias("records"), F.sum("n").alias("edges"), F.sum((F.col("n") > 1).cast("long")).alias("contested"), F.sum((F.col("good") > 1).cast("long")).alias("close"),
        F.sum((~F.col("before").eqNullSafe(F.col("entity_id"))).cast("long")).alias("changed"),
    )
    return rows.withColumn("price", F.lit(round(price, 4)))
