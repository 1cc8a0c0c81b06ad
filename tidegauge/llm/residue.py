"""Problem 6: residue of templates, filler, error pages and script notices among real passages.

Positive-unlabelled naive Bayes by expectation-maximisation. Trusted records are passages that hold an unfilled
placeholder or one of ten phrases that stand on any error page, script notice or filler; they are positive for good. All
others are unlabelled and begin as negative. The expectation step scores them with the present model, the maximisation
step counts their features by these scores, and so on; the model decides on all passages that aren't trusted.

What lets it find wordings that no trusted record holds:

* Passages of one wording (words in order, names and numbers left out) are a kind, and a kind counts once, not once a copy; kinds that always
  bear a name count the more the more names they were filled with, by the logarithm. In training a kind is no evidence on itself (one count of it is left
  out), so a notice repeated a thousand times doesn't vouch for itself.
* Beside its words and pairs of neighbours a kind has two features of its use: how often it bears a name, and a number. News
  tells of places and amounts; notices and filler stand alone.
* Sentences that deny an event on a date are reliable negatives, for by definition they are real.

Passages are parsed once. A round reads one row a kind, and the model has 2^18 hashed features, which bounds what goes to the driver and back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import BROADCAST_ROWS, cut

SLOTS = 1 << 18
ROUNDS = 6
#: Words and kinds that one task remembers at a time.
REMEMBERED = 200_000

#: An unfilled placeholder: a bare name between the marks of a template language, or a bracketed request to fill in.
PLACEHOLDER = re.compile(
    r"\{\{[^{}]{1,60}\}\}|\$\{[^{}]{1,60}\}|<%=?[^<>%]{1,60}%>|%\([A-Za-z_]\w{0,40}\)[sdif]|__[A-Za-z][A-Za-z_]*?__"
    r"|\{[A-Za-z]\w*_\w+\}|\{(?:name|place|county|count|acres|date|state|city|town|title|type|event|location|number|value|text|url|author|source|area|region)\}"
    r"|(?-i:<[A-Z][A-Z_ ]{1,40}>)|<(?:name|place|county|count|acres|date|event_type|location|insert[^<>]{0,40}|your [^<>]{1,40})>"
    r"|\[\s*(?:insert|enter|add|fill in|your|type)\b[^\[\]]{0,60}\]|\[[^\[\]]{1,40}\bhere\s*\]",
    re.I,
)
_BRACED = re.compile(r"^\s*(?:\{+|<|\[|\$\{|%\()\s*[A-Za-z_]+\s*(?:\}*|>|\]|\)s?)\s*$")

# Phrases that mark a trusted record, whatever the corpus.
TRUSTED = ("404 not found", "403 forbidden", "401 unauthorized", "500 internal server error", "502 bad gateway", "503 service unavailable", "504 gateway timeout", "enable javascript", "javascript is disabled", "lorem ipsum")

_OPENS = re.compile(r"[{$<%_\[]")
_DAY = r"\b(?:dates?|days?|timeframe|period)\b"
_NONE = r"\b(?:no|not|nothing|none)\b"
#: A sentence that reports that nothing happened or was reported on a date.
DENIES_EVENT = re.compile(rf"{_NONE}.*{_DAY}|{_DAY}.*{_NONE}", re.I | re.S)
_TOKEN = re.compile(r"\uFFFC|/[\w/.-]*\w[\w/.-]*|[^\W\d_]+(?:'[^\W\d_]+)?|\d[\d,.:-]*|[.!?]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _clean(text: str | None) -> str:
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("’", "'")
    return text


def has_placeholder(text: str) -> bool:
    return bool(_OPENS.search(text) and (PLACEHOLDER.search(text) or _BRACED.match(text)))


def phrase_pattern(phrases) -> re.Pattern | None:
    """A pattern of whole phrases, whatever stands between their words; None without phrases."""
    return re.compile(r"(?<![^\W_])(?:" + "|".join(re.escape(p).replace(r"\ ", r"[\W_]+") for p in phrases) + r")(?![^\W_])", re.I) if phrases else None


def is_trusted(text: str | None, phrase: re.Pattern | None = phrase_pattern(TRUSTED)) -> bool:
    """Whether the passage is a trusted positive."""
    text = _clean(text)
    return has_placeholder(text) or bool(phrase and phrase.search(text))


def wording(text: str | None) -> tuple[list[str], str, bool]:
    """The words in lower case without names and numbers, the names, and whether there is a number.

    A capitalised word is a name unless it begins a sentence and the next word isn't capitalised; texts in capitals
    or with capitalised words only have no names. Placeholders and paths are one word each.
    """
    text = _clean(text)
    if _OPENS.search(text):
        text = PLACEHOLDER.sub(" \uFFFC ", text)
    found = _TOKEN.findall(text)
    capital = [t[0].isupper() and (len(t) == 1 or t[1:].islower()) for t in found]
    masks = any(not c for c, t in zip(capital, found) if t[0].isalpha())
    words: list[str] = []
    names: list[str] = []
    number, begins, last = False, True, len(found) - 1
    for k, t in enumerate(found):
        c = t[0]
        if c in ".!?":
            begins = True
            continue
        if c == "\uFFFC":
            words.append("_placeholder")
        elif c == "/":
            words.append("_path")
        elif c.isdigit():
            number = True
        elif capital[k] and masks and (not begins or (k < last and capital[k + 1])):
            names.append(t)
        else:
            words.append(t.lower())
        begins = False
    return words, " ".join(names), number


#: Words of a window by which long sentences are judged; windows overlap by half.
WINDOW = 12


def windows(text: str | None) -> list[str]:
    """The sentences of a passage longer than one and a half windows, sentences longer than that as windows, each beginning at every half window; else the passage."""
    text = text or ""
    most, half = WINDOW * 3 // 2, WINDOW // 2
    if len(text) <= most or len(text.split(None, most)) <= most:
        return [text]
    parts = []
    for sentence in _SENTENCE.split(text):
        words = sentence.split()
        parts += [sentence] if len(words) <= most else [" ".join(words[k : k + WINDOW]) for k in range(0, len(words) - half, half)]
    return parts


class _Slots:
    """Hashed features of word lists: words and pairs of neighbours."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        found = set()
        for w in (*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w) & (SLOTS - 1)
            found.add(h)
        return sorted(found)


_UNIT = "id long, pos int, kind long, more array<long>, whole boolean, slots array<int>, bears_name boolean, bears_number boolean, names long, trusted boolean, denies boolean"


def _parse(phrases):
    """Each passage with its kind and the kinds of its parts; the features of a kind come with the first passage or part of it in the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, seen, texts, phrase = _Slots(), set(), {}, phrase_pattern(phrases)
        for batch in batches:
            rows = []
            for ident, pos, text in zip(batch["id"], batch["pos"], batch["text"]):
                if len(texts) > REMEMBERED or len(seen) > REMEMBERED:
                    texts.clear()
                    seen.clear()
                known = texts.get(text)
                if known is None:
                    words, names, number = wording(text)
                    kind = xxhash.xxh3_64_intdigest(" ".join(words)) >> 1
                    parts = windows(text)
                    trusted = is_trusted(text, phrase)
                    more = {}
                    for part in parts if len(parts) > 1 and not trusted else ():
                        # Only the whole passage can lack names or numbers.
                        own = wording(part)[0]
                        more.setdefault(xxhash.xxh3_64_intdigest(" ".join(own), 1 + 2 * bool(names) + number) >> 1, own)
                    known = kind, list(more), bool(names), number, xxhash.xxh3_64_intdigest(names) >> 1, trusted, bool(DENIES_EVENT.search(text or ""))
                    if text is not None and len(text) < 400:
                        texts[text] = known
                    for part, own in more.items():
                        if part not in seen:
                            seen.add(part)
                            rows.append((None, None, part, None, False, slots(own), bool(names), number, 0, False, False))
                    first = slots(words) if kind not in seen else None
                    seen.add(kind)
                else:
                    first = None
                kind, more, *rest = known
                rows.append((ident, pos, kind, more or None, True, first, *rest))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _UNIT.split(", ")]).astype({"id": "Int64", "pos": "Int32"})

    return run


def _units(passages: DataFrame, phrases=TRUSTED) -> DataFrame:
    rows = passages.select(F.col("id").cast("long").alias("id"), F.col("pos").cast("int").alias("pos"), "text").filter("id is not null and pos is not null")
    return cut(rows.mapInPandas(_parse(tuple(phrases)), _UNIT))


def _share(column: str) -> F.Column:
    """How often a kind bears it: 0 never, 1 in less than half of its passages, 2 in more, 3 always."""
    share = F.count_if(column) / F.count("*")
    return F.when(share < 0.05, 0).when(share < 0.5, 1).when(share < 0.95, 2).otherwise(3)


def _kinds(units: DataFrame) -> DataFrame:
    """One row per kind: features, the use of names and numbers, its count in training (0 for parts), whether trusted and whether it denies an event."""
    name = _share("bears_name")
    grouped = units.groupBy("kind", "whole").agg(
        F.first("slots", ignorenulls=True).alias("slots"),
        name.alias("name"),
        _share("bears_number").alias("number"),
        F.when(name < 3, 1.0).otherwise(1.0 + F.log2(F.greatest(F.approx_count_distinct("names"), F.lit(1)))).alias("n"),
        F.coalesce(F.bool_or("trusted"), F.lit(False)).alias("trusted"),
        F.coalesce(F.bool_or("denies"), F.lit(False)).alias("denies"),
    )
    return cut(grouped.withColumn("n", F.when(F.col("whole"), F.col("n")).otherwise(0.0)))


class Model:
    """Counts of the features by class: rows 0 to SLOTS - 1 the words, then four each for names and numbers, then all kinds."""

    def __init__(self, sums: np.ndarray) -> None:
        self.sums = sums

    def score(self, slots: list[np.ndarray], shape: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Log odds that each kind is residue. ``shape`` has its rows for names and numbers (-1: none); ``own`` how far it was taken for residue
        itself, if it is to be left out of the counts. The words of long kinds weigh less, so that length alone makes no surer.
        """
        pos, neg = self.sums[:, 0], self.sums[:, 1]
        sizes = np.fromiter(map(len, slots), np.int64, len(slots))
        mine, theirs = (0.0, 0.0) if own is None else (own, 1 - own)
        a, b = pos[-1] - mine + 1, neg[-1] - theirs + 1
        even = 0.5 / (a + b)  # smoothed so that a feature seen in neither class weighs nothing
        a, b, even = (np.broadcast_to(x, sizes.shape) for x in (a, b, even))
        mine, theirs = np.broadcast_to(mine, sizes.shape), np.broadcast_to(theirs, sizes.shape)

        def odds(at: np.ndarray, of: np.ndarray) -> np.ndarray:
            x = np.maximum(pos[at] - mine[of], 0) / a[of] + even[of]
            return np.log(x / (np.maximum(neg[at] - theirs[of], 0) / b[of] + even[of]))

        every = np.arange(len(slots))
        of = np.repeat(every, sizes)
        said = np.bincount(of, odds(np.concatenate([np.zeros(0, np.int64), *slots]).astype(np.int64), of), minlength=len(slots))
        out = np.log(a / b) + said * np.minimum(1.0, 12.0 / np.maximum(sizes, 1))
        for column in shape.T:
            there = every[column >= 0]
            out[there] += odds(column[there], there)
        return np.where(sizes > 0, out, -np.inf)

    def probability(self, *args) -> np.ndarray:
        score = self.score(*args)
        return np.where(np.isneginf(score), 0.0, 1 / (1 + np.exp(-np.clip(score, -30, 30))))


def _features(batch: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    slots = [np.zeros(0, np.int64) if s is None else np.asarray(s) for s in batch["slots"]]
    shape = np.stack([SLOTS + batch["name"].to_numpy(), SLOTS + 4 + batch["number"].to_numpy()], axis=1)
    part = ~batch["whole"].to_numpy(bool)
    shape[part[:, None] & (shape % 4 > 0)] = -1
    return slots, shape


def _weigh(shared):
    """One expectation step: by feature, how much of the kinds is positive and how much negative."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((SLOTS + 9, 2))
        for batch in batches:
            slots, shape = _features(batch)
            fixed = (batch["trusted"] | batch["denies"]).to_numpy(bool)
            p = start = batch["trusted"].to_numpy(np.float64)
            # What a kind was taken for in earlier rounds follows from their models.
            for model in shared.value:
                p = np.where(fixed, start, model.probability(slots, shape, p))
            n = batch["n"].to_numpy(np.float64)
            sizes = np.fromiter(map(len, slots), np.int64, len(slots))
            at = np.concatenate([*slots, shape[:, 0], shape[:, 1], np.full(len(n), SLOTS + 8)]).astype(np.int64)
            of = np.concatenate([np.repeat(np.arange(len(n)), sizes), *[np.arange(len(n))] * 3])
            sums[:, 0] += np.bincount(at, (n * p)[of], minlength=len(sums))
            sums[:, 1] += np.bincount(at, (n * (1 - p))[of], minlength=len(sums))
        used = np.nonzero(sums.sum(axis=1))[0]
        yield pd.DataFrame({"slot": used, "positive": sums[used, 0], "negative": sums[used, 1]})

    return run


def _learn(kinds: DataFrame, rounds: int) -> Model:
    spark, models = kinds.sparkSession, []
    trained = kinds.filter("whole")
    for _ in range(rounds + 1):
        shared = spark.sparkContext.broadcast(models)
        sums = trained.mapInPandas(_weigh(shared), "slot int, positive double, negative double").groupBy("slot").agg(F.sum("positive").alias("p"), F.sum("negative").alias("n")).toPandas()
        table = np.zeros((SLOTS + 9, 2))
        table[sums["slot"]] = sums[["p", "n"]].to_numpy()
        models.append(Model(table))
    return models[-1]


def fit(passages: DataFrame, rounds: int = ROUNDS) -> Model:
    """Learn the model from ``passages`` (id, pos, text); all of them count in every round."""
    return _learn(_kinds(_units(passages)), rounds)


def _score(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"kind": batch["kind"], "p": np.where(batch["denies"], 0.0, shared.value.probability(*_features(batch)))})

    return run


def _decide(units: DataFrame, kinds: DataFrame, model: Model, threshold: float) -> DataFrame:
    shared = units.sparkSession.sparkContext.broadcast(model)
    scored = kinds.mapInPandas(_score(shared), "kind long, p double")
    if kinds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        scored = F.broadcast(scored)
    whole = units.filter("whole").select("id", "pos", "kind", "more", "trusted").join(scored, "kind")
    alone = whole.filter("more is null").select("id", "pos", "p", "trusted")
    parted = whole.filter("more is not null").withColumn("row", F.monotonically_increasing_id()).select("row", "id", "pos", "trusted", "p", "more")
    best = cut(parted)
    parts = best.select("row", F.explode("more").alias("kind")).join(scored, "kind").groupBy("row").agg(F.max("p").alias("q"))
    parted = best.join(parts, "row", "left").select("id", "pos", F.greatest("p", "q").alias("p"), "trusted")
    p = F.when(F.col("trusted"), 1.0).otherwise(F.col("p"))
    return alone.unionByName(parted).select("id", "pos", p.alias("probability"), "trusted", (p >= threshold).alias("residue"))


def judge(passages: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Each passage of ``passages`` (id: integer, pos: integer, text) with probability (1 if trusted), trusted and residue (probability at least ``threshold``).

    A passage is as probable as its kind or, if it is long, as the likeliest of its parts; what denies an event on a date has probability 0. How often a kind bears names and numbers is taken from ``passages``.
    Rows without id or pos are left out; null, empty and wordless texts have probability 0. Repeated rows are judged each; other columns are dropped; an empty table gives an empty result.
    """
    units = _units(passages)
    return _decide(units, _kinds(units), model, threshold)


def fit_and_judge(passages: DataFrame, threshold: float = 0.5, rounds: int = ROUNDS, phrases=TRUSTED) -> DataFrame:
    """``judge`` of passages by the model that is learnt from themselves, trusting ``phrases``; they are parsed once for both."""
    units = _units(passages, phrases)
    kinds = _kinds(units)
    return _decide(units, kinds, _learn(kinds, rounds), threshold)


def records(judged: DataFrame) -> DataFrame:
    """The decision on each record: id, passages, residues, and exclude (no passage is left)."""
    return judged.groupBy("id").agg(F.count("*").alias("passages"), F.count_if("residue").alias("residues")).withColumn("exclude", F.col("passages") == F.col("residues"))
