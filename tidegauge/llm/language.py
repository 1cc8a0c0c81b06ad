"""Problem 9: documents without a language label or with a wrong one, and documents in several languages.

Multilingual mixture inference. Each language has a distribution over letter trigrams, trained here on documents that
carry its label and cleaned by expectation-maximisation, line by line, for labels are often wrong. A document is a
mixture of languages: expectation-maximisation estimates their proportions from the likelihoods of its lines,
and a language joins the set of the document only if the likelihood gains more than a penalty. Lines then get the best path
through that set, a change of language having its price, so that a short line without evidence follows its neighbours.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LANGUAGES = ("en", "es", "pt", "fr", "de", "it", "zh")
# Codes of ISO 639 and English names of the languages.
LABELS = {
    "en": "en", "eng": "en", "english": "en",
    "es": "es", "spa": "es", "spanish": "es", "castilian": "es",
    "pt": "pt", "por": "pt", "portuguese": "pt",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr",
    "de": "de", "deu": "de", "ger": "de", "german": "de",
    "it": "it", "ita": "it", "italian": "it",
    "zh": "zh", "zho": "zh", "chi": "zh", "cmn": "zh", "chinese": "zh", "mandarin": "zh",
}
# Frequent words of each language, from which a language without labelled documents starts.
FREQUENT = {
    "en": "the of and to in a is that for it was on are with as by at from have this",
    "es": "el la de que y en los se del las por un para con no una su al lo como más",
    "pt": "o de que e do da em um para com não uma os no se na por mais as dos foi ao",
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au les des est",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "it": "di che è e la il un a per in una mi sono ho non ma lo ha le si ti i con cosa gli",
    "zh": "的 是 不 我 一 有 大 在 人 了 中 到 资 要 可 以 这 个 你 会",
}

#: Documents with a language's label on which that language is trained, at most.
TRAINING_DOCUMENTS = 300
#: What a further language must gain in log likelihood, and what a change of language costs. Trigrams overlap, so each counts for a third.
PENALTY, CHANGE, OVERLAP = 6.0, 3.0, 3.0
_SLOTS = 1 << 16
_CHUNK = 400_000
_LINE_END = re.compile(r"\r\n|[\r\n\x85  ]")
_NAME = re.compile(r"[a-z]+")

_letter: np.ndarray | None = None


def _codes() -> np.ndarray:
    """Each code point of the basic plane as the trigrams see it: letters stay, Han letters are one, all else is a space."""
    global _letter
    if _letter is None:
        table = np.full(0x10000, 32, np.uint32)
        for c in range(0x10000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                table[c] = c
        table[0x3400:0xA000] = 0x4E00
        table[0xF900:0xFB00] = 0x4E00
        _letter = table
    return _letter


def label_of(lang: str | None) -> str | None:
    """The language that a label names; None for null, blank, marks of the unknown and other languages."""
    if not isinstance(lang, str):
        return None
    found = _NAME.match(lang.strip().lower())
    return LABELS.get(found[0]) if found else None


def _lines(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _LINE_END.split(text.lower())


def _grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all trigrams whose middle is a letter, and the line of each."""
    raw = np.frombuffer("\n".join(lines).encode("utf-32-le", "replace"), np.uint32)
    line = np.cumsum(raw == 10)
    code = np.where(raw < 0x10000, _codes()[np.minimum(raw, 0xFFFF)], np.where(raw >= 0x20000, 0x4E00, 32)).astype(np.uint32)
    code = np.concatenate([[32], code, [32]]).astype(np.uint32)
    with np.errstate(over="ignore"):
        h = (code[:-2] * np.uint32(0x9E3779B1)) ^ (code[1:-1] * np.uint32(0x85EBCA77)) ^ (code[2:] * np.uint32(0xC2B2AE3D))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    keep = code[1:-1] != 32
    return (h[keep] >> np.uint32(16)).astype(np.int64), line[keep]


def _likelihoods(lines: list[str], model: np.ndarray) -> np.ndarray:
    """Log likelihood of each line (row) in each language (column)."""
    out = np.zeros((len(lines), model.shape[1]))
    slot, line = _grams(lines)
    for k in range(0, len(slot), _CHUNK):
        part, at = model[slot[k : k + _CHUNK]], line[k : k + _CHUNK]
        lo, hi = at[0], at[-1] + 1
        for j in range(model.shape[1]):
            out[lo:hi, j] += np.bincount(at - lo, weights=part[:, j], minlength=hi - lo)
    return out


def _estimate(counts: np.ndarray, smoothing: float = 0.05) -> np.ndarray:
    p = counts + smoothing
    return np.log(p / p.sum(axis=0)).astype(np.float32)


def train(labelled: list[tuple[str, str]], rounds: int = 3) -> np.ndarray:
    """Log probabilities (slot, language) from (language, text) pairs; some of the languages may be wrong.

    The first round believes the labels; the next ones give each line to its likeliest language. The frequent words count throughout.
    """
    lines: list[str] = []
    said: list[int] = []
    for lang, text in labelled:
        for line in _lines(text):
            if line.strip():
                lines.append(line)
                said.append(LANGUAGES.index(lang))
    seed = np.zeros((_SLOTS, len(LANGUAGES)))
    for k, lang in enumerate(LANGUAGES):
        slot, _ = _grams([FREQUENT[lang]])
        np.add.at(seed[:, k], slot, 1.0)
    if not lines:
        return _estimate(seed)
    slot, line = _grams(lines)
    of = np.array(said)
    model = None
    for _ in range(rounds):
        counts = seed.copy()
        np.add.at(counts, (slot, of[line]), 1.0)
        model = _estimate(counts)
        score = np.stack([np.bincount(line, weights=model[slot, k], minlength=len(lines)) for k in range(len(LANGUAGES))], axis=1)
        score[np.arange(len(lines)), np.array(said)] += 3.0  # the label speaks where the line says little
        of = score.argmax(axis=1)
    return model


def fit(documents: DataFrame, per_language: int = TRAINING_DOCUMENTS) -> np.ndarray:
    """Train on at most ``per_language`` documents of each label, picked by a hash of their ids; see train().

    ``documents`` has id, text, lang. This bounded sample is all that is taken to the driver.
    """
    name = F.regexp_extract(F.lower(F.trim("lang")), "^[a-z]+", 0)
    known = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    labelled = documents.select("id", "text", F.try_element_at(known, name).alias("code")).filter("code is not null and text is not null")
    share = labelled.groupBy("code").agg(F.least(F.lit(1.0), 2.0 * per_language / F.count("*")).alias("share")).collect()
    if not share:
        return train([])
    point = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*(F.lit(x) for r in share for x in (r["code"], r["share"])))
    sample = labelled.withColumn("point", point).filter(F.col("point") < F.try_element_at(rate, F.col("code"))).orderBy("point", "id").limit(4 * per_language * len(share)).toPandas()
    sample = sample.groupby("code", sort=False).head(per_language)
    return train(list(zip(sample["code"], sample["text"])))


def _mixture(ll: np.ndarray, chosen: list[int]) -> float:
    """Log likelihood of the lines with the proportions that expectation-maximisation finds for the chosen languages."""
    part = ll[:, chosen]
    top = part.max(axis=1, keepdims=True)
    p = np.exp(part - top)
    share = np.full(len(chosen), 1 / len(chosen))
    for _ in range(12):
        r = p * share
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        share = np.maximum(r.mean(axis=0), 1e-12)
    return float((np.log(np.maximum(p @ share, 1e-300)) + top[:, 0]).sum())


def _languages(ll: np.ndarray) -> list[int]:
    """The set of languages of a document by penalised likelihood, grown one by one."""
    chosen = [int(ll.sum(axis=0).argmax())]
    best = _mixture(ll, chosen)
    while len(chosen) < ll.shape[1]:
        gains = [(_mixture(ll, [*chosen, k]), k) for k in range(ll.shape[1]) if k not in chosen]
        new, k = max(gains)
        if new - best <= PENALTY:
            break
        chosen.append(k)
        best = new
    return chosen


def _path(ll: np.ndarray, chosen: list[int]) -> list[int]:
    """The likeliest language of each line, changes having their price."""
    part = ll[:, chosen]
    score, back = part[0].copy(), []
    for row in part[1:]:
        jump = score.max() - CHANGE
        back.append(np.where(score >= jump, np.arange(len(chosen)), int(score.argmax())))
        score = np.maximum(score, jump) + row
    k = int(score.argmax())
    path = [k]
    for b in reversed(back):
        k = int(b[k])
        path.append(k)
    return [chosen[k] for k in reversed(path)]


def _confidence(total: np.ndarray, k: int) -> float:
    """Probability of language k."""
    z = np.exp(total - total.max())
    return float(z[k] / z.sum())


def segments(texts: list[str | None], model: np.ndarray) -> list[list[tuple[str, float, int]]]:
    """For each text its segments in order: language, confidence, number of lines. Texts without a letter have none."""
    split = [_lines(t) if t else [] for t in texts]
    ll = _likelihoods([line for own in split for line in own], model) / OVERLAP if any(split) else np.zeros((0, model.shape[1]))
    found: list[list[tuple[str, float, int]]] = []
    at = 0
    for own in split:
        part = ll[at : at + len(own)]
        at += len(own)
        part = part[part[:, 0] != 0]  # lines without a letter belong to whatever is around them
        if not len(part):
            found.append([])
            continue
        total = part.sum(axis=0)
        main = int(total.argmax())
        if (part.max(axis=1) - part[:, main]).sum() <= PENALTY:  # no set of languages can gain more than this
            found.append([(LANGUAGES[main], _confidence(total, main), len(part))])
            continue
        path = _path(part, _languages(part))
        runs, begin = [], 0
        for k in range(1, len(path) + 1):
            if k == len(path) or path[k] != path[begin]:
                runs.append((LANGUAGES[path[begin]], _confidence(part[begin:k].sum(axis=0), path[begin]), k - begin))
                begin = k
        found.append(runs)
    return found


_OUT = "doc_id long, seg_no int, language string, confidence double, lines int, segments int, label string"


def _assign(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.iloc[k : k + 500]
                rows = []
                for ident, lang, found in zip(part["id"], part["lang"], segments(list(part["text"]), model)):
                    label = label_of(lang)
                    rows.extend((ident, n, code, sure, lines, len(found), label) for n, (code, sure, lines) in enumerate(found))
                yield pd.DataFrame(rows, columns=["doc_id", "seg_no", "language", "confidence", "lines", "segments", "label"])

    return run


def language_segments(documents: DataFrame, model: np.ndarray | None = None) -> DataFrame:
    """Each document's segments, that is longest runs of lines in one language, with a confidence.

    ``documents`` has id (integer), text, lang. Returns doc_id, seg_no (from 0), language, confidence, lines, segments (of the document)
    and label (the language that lang names, or null). Rows without an id, null texts and texts without a letter give no row; a document in one
    language has segment 0 only; other columns are ignored. Without ``model`` it is fitted on the same documents.
    """
    if model is None:
        model = fit(documents)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return documents.select(F.col("id").cast("long").alias("id"), "text", "lang").filter("id is not null").mapInPandas(_assign(sent), _OUT)


def relabelled(found: DataFrame) -> DataFrame:
    """Of language_segments(): the documents whose label is missing or wrong, and all segments of those in several languages."""
    return found.filter("segments > 1 or label is null or label != language").select("doc_id", "seg_no", F.col("language").alias("true_lang"))
