"""Text cut off by field limits (problem 9).

One Arrow pass recomputes every text's length under several encodings
(characters, UTF-8 bytes, UTF-16 units, HTML escaping, JSON escaping, and each
with line ends rewritten) and inspects its ending.  Counted by source and
measure over different texts, a length at which far more texts stop than at
its neighbours is a hidden storage limit; of limits that the same texts show
under several measures the one that most texts obey is kept.

A text that stops at its source's limit is cut unless its ending says
otherwise, as whole texts of just that length occur.  Elsewhere (cut in mid
transfer) the ending alone must say so, and an unclear one doesn't.

Defined results: null and blank texts are whole; a text is cut if it stops
inside a word or sentence, whatever mark was added there; texts that end with
a list, signature, tag, code or heading line are whole; sources are compared
without case, blanks and ``-``/``_``; repeated rows give one row; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.session import materialize

#: Different texts that must stop at one length, beyond what chance gives
#: around the mean of the lengths this near.
LIMIT_TEXTS, NEARBY = 8, 12
#: Measures of length, the plainest first.
MEASURES = ("chars", "utf8", "utf16", "html", "json", "chars_crlf", "utf8_crlf", "html_crlf", "chars_lf", "utf8_lf", "html_lf")
#: A limit is the shadow of another one if so many of its texts obey that too.
SHADOW = 0.8

# Marks that programs leave where they cut.
_HARD_MARK = (
    r"(?:\[\s*(?:cut|truncated|snip(?:ped)?|more|continued|gekürzt|tronqué|cortado)\b[^\]]*\]|\(\s*(?:cut|truncated|snip(?:ped)?|more)\b[^)]*\)"
    r"|<\s*(?:cut|truncated|snip(?:ped)?|more)\b[^>]*>|(?:\.{2,}|…)?\s*[<\[(]\+?\d+\s*(?:more\s+)?(?:chars?|characters|bytes|words|Zeichen)[^>\])]*[>\])]|�+|\[\s*(?:\.{3}|…)\s*\])$"
)
_CLOSERS = "\"'”’»“«)]*_`"
_STOPS = ".?!。！？"


def source_key(c: Column) -> Column:
    """A source without case, blanks and dashes; null and blank become ''."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_"), F.lit(""))


def lengths(body: pa.Array) -> np.ndarray:
    """The length of each text under each of ``MEASURES``, one row a text."""
    count = lambda x: pc.count_substring(body, x).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = pc.utf8_length(body).to_numpy(zero_copy_only=False).astype(np.int64)
    utf8 = pc.binary_length(body).to_numpy(zero_copy_only=False).astype(np.int64)
    astral = pc.count_substring_regex(body, r"[\x{10000}-\x{10FFFF}]").to_numpy(zero_copy_only=False)
    crlf, lf, cr, quotes = count("\r\n"), count("\n"), count("\r"), count('"')
    html = chars + 4 * count("&") + 3 * (count("<") + count(">")) + 5 * (quotes + count("'"))
    json = chars + quotes + count("\\") + lf + cr + count("\t")
    grow = lf - crlf
    plain = [chars, utf8, chars + astral, html, json]
    return np.stack([*plain, chars + grow, utf8 + grow, html + grow, chars - crlf, utf8 - crlf, html - crlf], axis=1).astype(np.int32)


def hidden_limits(measured: DataFrame) -> DataFrame:
    """(source, measure, length, n): lengths at which a source stops its texts.

    ``measured`` has source, ``_h`` (a hash of the text: texts filed again
    count once) and ``lens``, its lengths by ``MEASURES``.  Counts come from
    all different texts, combined before the shuffle.
    """
    texts = measured.groupBy("source", "_h").agg(F.first("lens").alias("lens"))
    counts = texts.select("source", F.posexplode("lens").alias("m", "length")).groupBy("source", "m", "length").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source", "m").orderBy("length").rangeBetween(-NEARBY, NEARBY)
    mean = F.col("rest") / (2 * NEARBY)
    spikes = materialize(
        counts.withColumn("rest", F.sum("n").over(near) - F.col("n")).where(F.col("n") >= LIMIT_TEXTS + 3 * mean + 5 * F.sqrt(mean)).select("source", "m", "length", "n")
    )
    # Texts that obey two of them tell whether one is the other's shadow.
    obeyed = texts.select("source", "_h", F.posexplode("lens").alias("m", "length")).join(spikes, ["source", "m", "length"])
    obeyed = obeyed.groupBy("source", "_h").agg(F.collect_list(F.struct("m", "length", "n")).alias("a")).withColumn("b", F.col("a"))
    both = obeyed.select("source", F.explode("a").alias("a"), "b").select("source", "a", F.explode("b").alias("b")).groupBy("source", "a", "b").agg(F.count("*").alias("both"))
    more = (F.col("b.n") > 1.02 * F.col("a.n")) | ((1.02 * F.col("b.n") >= F.col("a.n")) & (F.col("b.m") < F.col("a.m")))
    shadows = both.where((F.col("both") >= SHADOW * F.col("a.n")) & more).select("source", F.col("a.m").alias("m"), F.col("a.length").alias("length")).distinct()
    names = F.array(*[F.lit(x) for x in MEASURES])
    kept = spikes.join(shadows, ["source", "m", "length"], "left_anti")
    return kept.select("source", F.element_at(names, F.col("m") + 1).alias("measure"), "length", "n")


_HARD = re.compile(_HARD_MARK, re.I)
_BULLET = re.compile(r"^\s*(?:[-*•·–▪◦+]|\d{1,3}[.)]|[a-z][.)]|\[[ xX]?\])\s+\S")
_PAIR = re.compile(r"^\s*[^\s:=][^:=]{0,30}\s*[:=]\s*\S.{0,80}$")
_TAGS = re.compile(r"^\s*(?:tags?|labels?|keywords?|topics?|schlagw\w+|stichw\w+|etiquetas|mots[- ]cl\w+|palabras clave|see also|cc|ref|refs)\s*:", re.I)
_SIGN = re.compile(r"^\s*(?:—|--|–|~)\s*\S")
_CLOSING = re.compile(
    r"^\s*(?:(?:best|kind|warm|many)?\s*(?:regards|wishes|thanks)|thanks|thank you|cheers|yours\b.*|sincerely|mit freundlichen gr\S+|viele gr\S+|saludos(?: cordiales)?|atentamente|cordialement|bien à vous|salutations)\s*[,.!]?\s*$",
    re.I,
)
_PATHS = re.compile(r"(?:^|\s)(?:https?://\S+|[\w.~-]*/[\w./~-]*\.[a-z0-9]{1,5}|<[^<>\s]+>)\s*$")
_SENTENCES = re.compile(r"[.?!](?:[\"'”’»)\]]*)(?=\s)")


def parted(text: str) -> tuple[str, str, bool]:
    """(body, mark, soft): the text before a mark that a program left where it
    cut, that mark, and whether the body ends with an ellipsis.

    A mark holds no closing bracket but its last character (or replacement
    characters only), so the search begins after the closing bracket before."""
    whole = text.rstrip()
    mark = ""
    if whole.endswith(("]", ")", ">")):
        hit = _HARD.search(whole, whole.rfind(whole[-1], 0, len(whole) - 1) + 1)
        mark = whole[hit.start() :] if hit else ""
    elif whole.endswith("\ufffd"):
        mark = whole[len(whole.rstrip("\ufffd")) :]
    body = whole[: len(whole) - len(mark)].rstrip() if mark else whole
    return body, mark, body.endswith(("…", ".."))


def ended(body: str) -> bool:
    """Whether a text ends with a stop, quotes and brackets after it aside."""
    return body.rstrip().rstrip(_CLOSERS).endswith(tuple(_STOPS))


def last_words(body: str) -> str:
    """The end of ``body`` that holds its last three words, if it has so many."""
    at, words = len(body), 0
    while at and words < 4:
        at -= 1
        words += (body[at].isalnum() or body[at] == "_") and not (at and (body[at - 1].isalnum() or body[at - 1] == "_"))
    return body[at:]


def without_ellipsis(body: str) -> str:
    """``body`` without the ellipsis at its end."""
    return body[:-1].rstrip() if body.endswith("…") else body.rstrip(".").rstrip()


def inspect(text: str) -> tuple[str, str]:
    """(verdict, phrase): ``whole``, ``cut``, or ``soft`` (an ellipsis; phrase
    holds the words before it), ``odd`` (no grammar to go by)."""
    body, mark, soft = parted(text)
    if mark:
        return ("whole" if ended(body) and not soft and "\ufffd" not in mark else "cut"), ""
    if soft:
        return "soft", " ".join(re.findall(r"\w+", last_words(without_ellipsis(body)))[-3:]).lower()
    if ended(body):
        return ("odd" if re.fullmatch(r"\d\.", body[-2:]) else "whole"), ""
    lines = body.splitlines()
    last = lines[-1]
    before = [x for x in lines[:-1]]
    block = [last]  # the last paragraph
    for x in reversed(before):
        if not x.strip():
            break
        block.append(x)
    alone = len(block) == 1
    if last.strip().startswith(("```", "~~~")) or body.count("```") % 2 == 1:
        return "whole", ""
    if re.match(r"^\s*(?:</\w+>|[}\])]+;?|-{3,}|={3,}|\*{3,}|_{3,})\s*$", last):
        return "whole", ""
    letters = [c for c in last if c.isalpha()]
    if len(letters) >= 5 and len(last) <= 60 and all(c.isupper() for c in letters) and any(c.islower() for c in body):
        return "whole", ""  # END OF NOTE and headings in capitals
    if _BULLET.match(last):
        others = [x for x in before if _BULLET.match(x)]
        if others:
            return ("cut" if ended(others[-1]) else "whole"), ""
        return ("odd" if len(last.split()) <= 5 else "cut"), ""
    if _TAGS.match(last) or _PATHS.search(last):
        return "whole", ""
    if _SIGN.match(last) and (alone or _CLOSING.match(block[1])):
        return "whole", ""
    if len(block) >= 2 and len(last.split()) <= 6 and (_CLOSING.match(block[1]) or any(_CLOSING.match(x) for x in block[1:3])):
        return "whole", ""
    if len(block) >= 2 and all(_PAIR.match(x) and len(x.split()) <= 6 and not ended(x) for x in block):
        return "whole", ""
    if re.match(r"^\s*#{1,6}\s+\S", last) or re.match(r"^\s*==+\s*\S", last):
        return "odd", ""
    tail = "\n".join(reversed(block))
    if not _SENTENCES.search(body) or (len(tail.split()) >= 25 and not re.search(r"[.?!,;:](?:\s|$)", tail)):
        return "odd", ""  # written without punctuation
    return "cut", ""


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        bodies = []
        for text in texts:
            body, mark, soft = parted(text)
            bodies.append(without_ellipsis(body) if soft else body if mark else text)
        lens = lengths(pa.array(bodies, pa.string()))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(MEASURES)), pa.array(lens.ravel()))
        found = [inspect(x) for x in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), rows, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())],
            ["doc_id", "source", "_h", "lens", "verdict", "phrase"],
        )


def measured_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, source, _h, lens, verdict, phrase) of the texts that hold
    anything; lengths are those of the text before a mark added at a break."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), F.col("text").cast("string").alias("text"))
    rows = rows.where("text is not null and text rlike '\\\\S'").withColumn("_h", F.xxhash64("text"))
    return rows.mapInArrow(_measure, "doc_id long, source string, _h long, lens array<int>, verdict string, phrase string")


def judged(documents: DataFrame, endings: bool = True) -> DataFrame:
    """(doc_id, source, at_limit, verdict): the documents whose text was cut
    off.  Without ``endings`` every text that stops at a limit of its source
    is named and no other, whatever it looks like."""
    rows = materialize(measured_texts(documents))
    limits = materialize(hidden_limits(rows))
    order = F.create_map(*[x for i, m in enumerate(MEASURES) for x in (F.lit(m), F.lit(i))])
    unclear = rows.where("verdict != 'whole'") if endings else rows
    keys = limits.select("source", order[F.col("measure")].alias("m"), "length", F.lit(True).alias("hit"))
    at = unclear.select("doc_id", "source", F.posexplode("lens").alias("m", "length")).join(keys, ["source", "m", "length"]).select("doc_id").distinct()
    placed = unclear.drop("lens").join(at.withColumn("at_limit", F.lit(True)), "doc_id", "left").withColumn("at_limit", F.coalesce("at_limit", F.lit(False)))
    if not endings:
        return placed.where("at_limit").select("doc_id", "source", "at_limit", "verdict").distinct()
    # An author's own ellipsis comes after a phrase that recurs in different
    # texts; copies of one text count once.
    texts = rows.where("verdict = 'soft'").select("phrase", "_h").distinct()
    phrases = texts.groupBy("phrase").agg(F.count("*").alias("k"))
    total = texts.count()
    own = phrases.where((F.col("k") >= 3) & (F.col("k") >= 0.005 * total)).select("phrase", F.lit(True).alias("own"))
    cut = F.col("at_limit") | (F.col("verdict") == "cut") | ((F.col("verdict") == "soft") & F.col("own").isNull())
    return placed.join(own, "phrase", "left").where(cut).select("doc_id", "source", "at_limit", "verdict").distinct()


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, at_limit): the documents whose text was cut off."""
    return judged(documents).select("doc_id", "source", "at_limit").distinct()


def truncation_rates(documents: DataFrame) -> DataFrame:
    """Per source: texts, texts cut, share, and how many stop at a limit."""
    texts = documents.where("text is not null and text rlike '\\\\S'").groupBy(source_key(F.col("source")).alias("source")).agg(F.count("*").alias("texts"))
    cut = truncated(documents).groupBy("source").agg(F.count("*").alias("cut"), F.sum(F.col("at_limit").cast("int")).alias("at_limit"))
    return texts.join(cut, "source", "left").select(
        "source",
        "texts",
        F.coalesce("cut", F.lit(0)).alias("cut"),
        F.coalesce("at_limit", F.lit(0)).alias("at_limit"),
        F.round(F.coalesce("cut", F.lit(0)) / F.col("texts"), 6).alias("share"),
    )
