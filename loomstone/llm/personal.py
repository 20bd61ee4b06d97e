"""Personal information inside free text (problem 3).

A linear-chain conditional random field over word-shape features tags tokens
as names, e-mail addresses, phone numbers, identity numbers and street
addresses.  It is trained on the driver from the small labelled table of
``labelled`` (a fixed number of sentences, a few seconds) and decoded by
Viterbi in numpy batches.  Features are hashed: a word's own traits are looked
up once, what joins neighbours is mixed over whole batches in numpy.  Found
items become typed placeholders.

Defined results: null and blank texts hold nothing; equal texts are tagged
alike; a payload delivered twice counts once; an item never spans two kinds;
an empty table gives an empty result; texts of any length are tagged whole;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.labelled import GIVEN, SENTENCES, sentences
from loomstone.llm.names import NICK, NICKNAMES, TITLES, plain

KINDS = ("name", "email", "phone", "id", "address")
LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
#: Cells of the table of hashed weights, and tokens decoded at once.
WEIGHTS, AT_ONCE = 1 << 18, 100_000

_TOKEN = re.compile(r"\d+|[^\W\d_]+|\s*\n\s*|[^\w\s]|_")
_DOT = r"(?:\.|\[dot\]|\(dot\)|\sdot\s)"
_EMAIL = re.compile(rf"[\w.+-]+(?:\s?@\s?|%40|\s?\[at\]\s?|\s?\(at\)\s?|\sat\s(?=[\w-]+\sdot\s))[\w-]+(?:{_DOT}[\w-]+)+", re.I)
_RUN = re.compile(r"(?<![\w.])\+?\(?\d(?:[\d() .-]*\d)?(?![\w])")
_IDS = [
    ("ssn", re.compile(r"(?<![\w-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])")), ("nine", re.compile(r"(?<![\w-])\d{9}(?![\w-])")), ("pass", re.compile(r"(?<!\w)[A-Z] ?\d{7}(?!\w)", re.I)),
    ("nino", re.compile(r"(?<!\w)[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)", re.I)), ("dni", re.compile(r"(?<!\w)\d{8}-?[A-Z](?!\w)", re.I)), ("lic", re.compile(r"(?<!\w)[A-Z]\d{3}[- ]\d{3}[- ]\d{2}(?!\w)", re.I)),
]
_POST = re.compile(r"(?<!\w)(?:[A-Z]{1,2}\d{1,2} \d[A-Z]{2}|0\d{4})(?!\w)")
# Words of street addresses and of identity documents.
STREET = set("st street ave avenue road rd lane ln drive dr blvd boulevard court ct pkwy parkway way place close crescent terrace flat unit apt suite rue calle weg platz avenida via plaza str ter cir sq row hwy trail loop".split())
PAPERS = set("ssn social sec soc security passport dni nino nie licence license insurance id card national identity travel document visa permit residence".split())
KNOWN = {plain(x) for x in GIVEN} | set(NICK) | {plain(x.split(":")[0].strip()) for x in NICKNAMES.split(";") if ":" in x}


def shape(w: str) -> str:
    out = re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", re.sub(r"\d", "9", w))
    return re.sub(r"(.)\1{3,}", r"\1\1\1\1", out)


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s)


_EDGE = _hash("beyond the text")
#: Columns of features every token has (hashes), before the marks.
COLUMNS = 21


@lru_cache(maxsize=500_000)
def word_traits(w: str) -> tuple[int, ...]:
    """Hashes of a token's lower form, shape, flags, ends and length."""
    if "\n" in w:
        low = form = "\n"
    else:
        low, form = w.lower(), shape(w)
    p = plain(low) if low.isalpha() else low
    flags = (
        ("g" if p in KNOWN else "") + ("t" if p in TITLES else "") + ("p" if p in PAPERS else "")
        + ("s" if p in STREET or (len(p) > 6 and p.endswith(("gasse", "weg", "str", "strasse", "platz"))) else "")
        + ("i" if len(low) == 1 and w.isupper() else "")
    )
    ends = (low[-3:] if len(low) > 4 else "", low[-2:] if len(low) > 3 else "")
    return (_hash("w" + low), _hash("s" + form), _hash("f" + flags), _hash("3" + ends[0]), _hash("2" + ends[1]), _hash(f"z{min(len(low), 8)}"))


def marks(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, str]]:
    """(token, name) of the patterns that tokens take part in."""
    n = len(spans)
    out: list[tuple[int, str]] = []
    begin: dict[int, int] | None = None

    def mark(m: re.Match, name: str) -> None:
        nonlocal begin
        if begin is None:
            begin = {s: i for i, (s, _) in enumerate(spans)}
        i = begin.get(m.start())
        if i is None:
            return
        out.append((i, name + "<"))
        while i < n and spans[i][0] < m.end():
            out.append((i, name))
            i += 1

    for m in _EMAIL.finditer(text):
        after = text[m.end() : m.end() + 2]
        odd = "v" if re.search(r"@\s?v?\d", m[0]) else "repo" if re.match(r":\w", after) else "host" if m[0].lower().startswith(("git@", "deploy@", "root@", "admin@")) else ""
        mark(m, "EMAIL" + odd)
    if not _DIGIT.search(text):
        return out
    for m in _RUN.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        if len(digits) >= 5:
            groups = [len(x) for x in re.findall(r"\d+", m[0])]
            kind = ("+" if m[0][0] == "+" else "(" if "(" in m[0] else "") + ("0" if digits[0] == "0" else "") + ("." if "." in m[0] else "")
            mark(m, f"RUN{kind}{'-'.join(map(str, groups))}")
            mark(m, f"DIGITS{kind}{min(len(digits), 14)}" + ("s" if len(groups) > 1 else ""))
    for name, pattern in _IDS:
        for m in pattern.finditer(text):
            mark(m, "ID" + name)
    for m in _POST.finditer(text):
        mark(m, "POST")
    return out


_DIGIT = re.compile(r"\d")
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _mix(kind: int, *parts: np.ndarray) -> np.ndarray:
    """One hash for each row of several hashes, by kind of feature."""
    h = np.full(len(parts[0]), kind, np.uint64)
    for k, p in enumerate(parts):
        h = (h ^ (p + _K[k])) * _K[0]
        h ^= h >> np.uint64(32)
    return (h & np.uint64(WEIGHTS - 1)).astype(np.int64)


def features(texts: list[str], all_spans: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, token, mark): the hashed features of all tokens of the texts, a
    row of ``COLUMNS`` each, and the tokens' further features."""
    traits, joined, at, ids = [], [], [], []
    base = 0
    for text, spans in zip(texts, all_spans):
        traits += [word_traits(text[a:b]) for a, b in spans]
        joined += [x[1] == y[0] for x, y in zip(spans, spans[1:])] + [False] * bool(spans)
        n = len(spans)
        for i, name in marks(text, spans):
            h = _hash(name)
            at += [base + i]
            ids += [h]
            if i + 1 < n:
                at += [base + i + 1]
                ids += [h ^ 0x5555]
            if i:
                at += [base + i - 1]
                ids += [h ^ 0xAAAA]
        base += n
    if not base:
        return np.zeros((0, COLUMNS), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        w, s, f, x3, x2, z = np.array(traits, np.uint64).T
        f = f + np.array(joined).astype(np.uint64) * _K[3]
        text_no = np.repeat(np.arange(len(texts)), [len(x) for x in all_spans])

        def near(col: np.ndarray, k: int) -> np.ndarray:
            out = np.full(base, _EDGE, np.uint64)
            if k > 0 and base > k:
                out[:-k] = np.where(text_no[k:] == text_no[:-k], col[k:], np.uint64(_EDGE))
            elif k < 0 and base > -k:
                out[-k:] = np.where(text_no[:k] == text_no[-k:], col[:k], np.uint64(_EDGE))
            return out

        w1, w2, v1, v2 = near(w, 1), near(w, 2), near(w, -1), near(w, -2)
        s1, t1, f1, f2, g1, g2 = near(s, 1), near(s, -1), near(f, 1), near(f, 2), near(f, -1), near(f, -2)
        table = np.stack([
            np.zeros(base, np.int64), _mix(1, w), _mix(2, s), _mix(3, f), _mix(4, x3), _mix(5, x2), _mix(6, z), _mix(7, v1), _mix(8, w1), _mix(9, v2), _mix(10, w2),
            _mix(11, t1, s), _mix(12, s, s1), _mix(13, g1, f), _mix(14, f, f1), _mix(15, g2, g1, f), _mix(16, f, f1, f2), _mix(17, v1, s), _mix(18, s, w1), _mix(19, v1, f, w1), _mix(20, v2, v1),
        ], axis=1)
        extra = _mix(21, np.array(ids, np.uint64)) if ids else np.zeros(0, np.int64)
    return table, np.array(at, np.int64), extra


class Tagger:
    """Weights of a linear-chain CRF; ``fit`` and ``decode`` run in numpy."""

    def __init__(self) -> None:
        self.weights = np.zeros((WEIGHTS, len(LABELS)), np.float32)
        self.moves = np.zeros((len(LABELS), len(LABELS)))

    def emissions(self, table: np.ndarray, token: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Each token's score for each label."""
        out = np.zeros((len(table), len(LABELS)), np.float32)
        for k in range(table.shape[1]):
            out += self.weights[table[:, k]]
        np.add.at(out, token, self.weights[mark])
        return out

    def fit(self, data: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 9, rate: float = 0.12, decay: float = 2e-4, batch: int = 96) -> Tagger:
        """Adam on the negative log-likelihood, in batches of like length; a
        feature must occur three times to have a weight."""
        rows = []
        for text, items in data:
            spans = tokens(text)
            if spans:
                table, token, mark = features([text], [spans])
                flat = np.concatenate((table.ravel(), mark))
                place = np.concatenate((np.repeat(np.arange(len(spans)), table.shape[1]), token))
                rows.append((flat, place, labels_of(spans, items)))
        known, counts = np.unique(np.concatenate([r[0] for r in rows]), return_counts=True)
        known = known[(counts >= 3) | (known == 0)]
        ready = []
        for flat, place, y in rows:
            slot = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            good = known[slot] == flat
            slot, place = slot[good], place[good]
            order = np.argsort(place, kind="stable")
            ready.append((slot[order], np.bincount(place, minlength=len(y)), y))
        ready.sort(key=lambda x: len(x[2]))
        parts = [self._batch(ready[k : k + batch]) for k in range(0, len(ready), batch)]
        compact = np.zeros((len(known), len(LABELS)))
        params = [compact, self.moves]
        first = [np.zeros_like(p) for p in params]
        second = [np.zeros_like(p) for p in params]
        order, step = np.random.default_rng(11), 0
        for epoch in range(epochs):
            for k in order.permutation(len(parts)):
                step += 1
                now = rate * (1 - 0.8 * epoch / epochs)
                for p, g, f, s in zip(params, self._gradient(parts[k], compact), first, second):
                    g = g + decay * p
                    f *= 0.9
                    f += 0.1 * g
                    s *= 0.99
                    s += 0.01 * g * g
                    p -= now * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        self.weights[known] = compact
        for i, x in enumerate(LABELS):  # an item never begins inside
            for j, y in enumerate(LABELS):
                if y[0] == "I" and x[1:] != y[1:]:
                    self.moves[i, j] = -1e4
        return self

    @staticmethod
    def _batch(data: list[tuple[np.ndarray, np.ndarray, list[int]]]) -> dict:
        """Flat arrays of one batch, sorted once for the gradient's sums."""
        flat = np.concatenate([x[0] for x in data])
        sizes = np.concatenate([x[1] for x in data])
        lengths = np.array([len(y) for *_, y in data])
        longest = int(lengths.max())
        gold = np.concatenate([y for *_, y in data])
        moves = np.zeros((len(LABELS), len(LABELS)))
        for *_, y in data:
            np.add.at(moves, (y[:-1], y[1:]), 1)
        by = np.argsort(flat, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], flat[by][1:] != flat[by][:-1])))
        return {
            "n": len(data), "longest": longest, "flat": flat, "starts": np.concatenate(([0], np.cumsum(sizes)[:-1])), "hot": np.eye(len(LABELS))[gold], "moves": moves,
            "place": np.concatenate([k * longest + np.arange(n) for k, n in enumerate(lengths)]), "mask": (np.arange(longest)[None, :] < lengths[:, None]).astype(float),
            "heads": heads, "present": flat[by][heads], "tokens": np.repeat(np.arange(len(sizes)), sizes)[by], "size": len(gold),
        }

    def _gradient(self, b: dict, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean negative log-likelihood: expected less observed counts,
        by forward and backward passes over scaled probabilities."""
        n, longest, n_labels, mask = b["n"], b["longest"], len(LABELS), b["mask"]
        emit = np.zeros((n * longest, n_labels))
        emit[b["place"]] = np.add.reduceat(weights[b["flat"]], b["starts"], axis=0)
        emit = emit.reshape(n, longest, n_labels)
        e, t = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(self.moves)
        alpha, beta, scale = np.zeros_like(e), np.zeros_like(e), np.ones((n, longest))
        alpha[:, 0] = e[:, 0]
        scale[:, 0] = alpha[:, 0].sum(1)
        alpha[:, 0] /= scale[:, 0, None]
        for i in range(1, longest):
            live = mask[:, i, None]
            a = (alpha[:, i - 1] @ t) * e[:, i] * live + alpha[:, i - 1] * (1 - live)
            scale[:, i] = a.sum(1)
            alpha[:, i] = a / scale[:, i, None]
        beta[:, -1] = 1
        pair = np.zeros_like(t)
        for i in range(longest - 1, 0, -1):
            live = mask[:, i, None]
            right = e[:, i] * beta[:, i] / scale[:, i, None]
            pair += (alpha[:, i - 1].T @ (right * live)) * t
            beta[:, i - 1] = (right @ t.T) * live + beta[:, i] * (1 - live)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        miss = post.reshape(-1, n_labels)[b["place"]] - b["hot"]
        grad = np.zeros_like(weights)
        grad[b["present"]] = np.add.reduceat(miss[b["tokens"]], b["heads"], axis=0)
        return grad / n, (pair - b["moves"]) / n

    def decode(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi paths of a batch of texts of similar length, given each
        text's emissions."""
        if not batch:
            return []
        lengths = np.array([len(x) for x in batch])
        longest = int(lengths.max())
        emit = np.zeros((len(batch), longest, len(LABELS)))
        for k, own in enumerate(batch):
            emit[k, : len(own)] = own
        best = emit[:, 0].copy()
        best[:, [i for i, x in enumerate(LABELS) if x[0] == "I"]] = -1e4
        back = np.zeros((len(batch), longest, len(LABELS)), np.int8)
        for i in range(1, longest):
            score = best[:, :, None] + self.moves[None]
            back[:, i] = score.argmax(1)
            new = score.max(1) + emit[:, i]
            live = (i < lengths)[:, None]
            best = np.where(live, new, best)
            back[:, i] = np.where(live, back[:, i], np.arange(len(LABELS)))
        path = np.zeros((len(batch), longest), np.int64)
        path[:, -1] = best.argmax(1)
        for i in range(longest - 1, 0, -1):
            path[:, i - 1] = back[np.arange(len(batch)), i, path[:, i]]
        return [p[:n] for p, n in zip(path, lengths)]


def labels_of(spans: list[tuple[int, int]], items: list[tuple[int, int, str]]) -> list[int]:
    y = []
    for a, b in spans:
        own = next(((s, k) for s, e, k in items if s <= a and b <= e), None)
        y.append(0 if own is None else LABELS.index(("B-" if own[0] == a else "I-") + own[1]))
    return y


@lru_cache(maxsize=2)
def trained(n: int = SENTENCES, seed: int = 7) -> Tagger:
    """The tagger fitted to n sentences of the labelled table."""
    return Tagger().fit(sentences(n, seed))


def _sound(kind: str, text: str, a: int, b: int) -> bool:
    """Exact check of an item: what no item of its kind can lack."""
    s = text[a:b]
    if kind == "email":
        return bool(re.search(r"@|%40|\bat\b", s, re.I)) and not re.search(r"@\s?v?\d|@sha\d", s) and not re.match(r":[\w/]", text[b : b + 2])
    digits = sum(c.isdigit() for c in s)
    if kind == "phone":
        return 7 <= digits <= 18
    if kind == "id":
        return digits >= 6
    if kind == "address":
        return digits >= 1 and sum(c.isalpha() for c in s) >= 6
    return sum(c.isalpha() for c in s) >= 3 and not any(c.isdigit() for c in s)


def tag(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Items (from, to, kind) of each text, in order."""
    all_spans = [tokens(t) for t in texts]
    order = sorted((k for k, x in enumerate(all_spans) if x), key=lambda k: len(all_spans[k]))
    labels = [np.zeros(len(s), np.int64) for s in all_spans]
    while order:
        # As many texts, the longest of them last, as fit the bound; one at least.
        n = 1
        while n < len(order) and len(all_spans[order[n]]) * (n + 1) <= AT_ONCE:
            n += 1
        part, order = order[:n], order[n:]
        scores = tagger.emissions(*features([texts[k] for k in part], [all_spans[k] for k in part]))
        cuts = np.cumsum([len(all_spans[k]) for k in part])[:-1]
        for k, path in zip(part, tagger.decode(np.split(scores, cuts))):
            labels[k] = path
    out = []
    for text, spans, own in zip(texts, all_spans, labels):
        items: list[tuple[int, int, str]] = []
        for (a, b), y in zip(spans, own):
            if y == 0:
                continue
            kind = LABELS[y][2:]
            if LABELS[y][0] == "I" and items and items[-1][2] == kind:
                items[-1] = (items[-1][0], b, kind)
            else:
                items.append((a, b, kind))
        out.append([(a, b, k) for a, b, k in items if _sound(k, text, a, b)])
    return out


def redact(text: str, items: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in items:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


FIELDS = {"prompt": "prompt", "tool_input.prompt": "tool_input.prompt", "tool_input.command": "tool_input.command"}


def field_texts(payloads: DataFrame) -> DataFrame:
    """(payload_id, field, text): the texts of the three fields, each once."""
    parts = F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).alias("text")) for k, c in FIELDS.items()])
    rows = payloads.select(F.col("payload_id").cast("long").alias("payload_id"), F.explode(F.filter(parts, lambda p: p["text"].isNotNull())).alias("p"))
    return rows.select("payload_id", "p.field", "p.text").groupBy("payload_id", "field").agg(F.max("text").alias("text"))


def tagged(payloads: DataFrame) -> DataFrame:
    """(payload_id, field, redacted, items): the texts with their placeholders;
    ``items`` lists kind, occurrence, start and end."""
    spark = payloads.sparkSession
    shared = spark.sparkContext.broadcast(trained())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = shared.value
        for pdf in batches:
            distinct = list(dict.fromkeys(pdf["text"]))
            known = {}
            for text, items in zip(distinct, tag(tagger, distinct)):
                seen: dict[str, int] = {}
                rows = []
                for a, b, kind in items:
                    seen[kind] = seen.get(kind, 0) + 1
                    rows.append({"kind": kind, "occurrence": seen[kind], "start": a, "end": b})
                known[text] = (redact(text, items), rows)
            yield pd.DataFrame(
                {"payload_id": pdf["payload_id"], "field": pdf["field"], "redacted": [known[t][0] for t in pdf["text"]], "items": [known[t][1] for t in pdf["text"]]}
            )

    schema = "payload_id long, field string, redacted string, items array<struct<kind:string,occurrence:long,start:int,end:int>>"
    return field_texts(payloads).mapInPandas(run, schema)


def found(payloads: DataFrame) -> DataFrame:
    """(payload_id, field, kind, occurrence) of every item."""
    return tagged(payloads).select("payload_id", "field", F.explode("items").alias("i")).select("payload_id", "field", "i.kind", "i.occurrence")
