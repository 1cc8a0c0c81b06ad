"""Problem 3: defective answers of question-answer records, each with its type of defect.

Refusals are found by recurrence alone, without a list of phrases. Openings of answers (eight words, numbers and names masked)
are clustered by MinHash over their words, each link verified by the exact share of words in the same order, and by the runs of words, some left out,
that they share, which gives every link that MinHash and the neighbours in its buckets miss; so one word that
varies splits no template of five words or more. A real answer bears content: a number or name that the question doesn't have, an option
of the question or its label. A cluster that recurs across unrelated prompts and whose answers mostly bear none is a template of
refusals. An answer is a refusal if it bears no number of its own and begins as a template does, or holds within its first
words a run of five words of a template that answers with numbers of their own don't have.

Checks against the question name the other defects: nothing but signs (empty), the question given back (copied_question), another
language than the question's (other_language, by the trigram model of the language operator), and an end within a
sentence (truncated).
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.words import words
from ..session import cut
from . import language

#: Openings are linked if so much of the longer one's words stand in both in the same order.
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Openings of more words would have too many subsequences; those of the query have OPENING_WORDS.
MOST_WORDS = 16
#: Words of an opening, and words within which runs of a template are looked for; shorter texts than LEAST_WORDS are bare labels and phrases.
OPENING_WORDS, RUN_WITHIN, RUN_WORDS, LEAST_WORDS = 8, 12, 5, 4
#: Masked prompts that a cluster must recur across to be a template, the share of its answers that must bear no content, and the share of
#: answers with a run that must bear no number of their own; prompts are told apart by so many first words.
PROMPTS, FREE, BARE, PROMPT_WORDS = 3, 0.5, 0.9, 12
#: A bucket of openings that holds more than this is split among several tasks.
HOT_BUCKET = 100_000
#: A text of so many words is a sentence; shorter ones may be whole without a full stop.
SENTENCE_WORDS = 7
#: Log likelihood by which another language must beat the question's.
LANGUAGE_MARGIN = 10.0

# Words that stand for no answer.
NO_ANSWER = {"none", "null", "nil", "na", "n a", "nan", "no answer", "no response", "not available", "not applicable", "undefined", "empty", "blank", "unanswered"}
# Words that no sentence ends with.
DANGLING = set("a an and although as at because between but by for from if in into near nor of on or our over than that the their this to under until when where whether which while who whose with within without".split())

# Words that only announce an answer or a question.
ANNOUNCING = {"answer", "question", "response", "reply", "prompt", "q", "a", "respuesta", "pregunta"}
_LABEL = re.compile(r"^\s*[(\[]?([A-Ha-h])(?:[)\].:]+(?=\s|$)|[ \t]*(?=\n|$))\s*")
_MARKUP = re.compile(r"<[^<>]{0,60}>|&[a-z]{2,8};|&#\d{1,6};")
_OPTION = re.compile(r"^\s*[(\[]?[A-Ha-h][)\].:]\s+(.*)$")
_END = re.compile(r"[.!?。！？…]['\"”’»)\]\s]*$")
_ELLIPSIS = re.compile(r"(?:\.\.+|…)['\"”’»)\]\s]*$")
_SENTENCE = re.compile(r"[.!?:。！？]+(?=\s|$)|\n")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_STOP = re.compile(r"[.!?]\s")
_I = ("I", "I'm", "I'd", "I'll", "I've")


def _plain(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("’", "'").replace("‘", "'")
    return text


def body(text: str) -> tuple[str, bool]:
    """The answer without markup and leading option label, and whether it had a label."""
    text = _MARKUP.sub(" ", _plain(text))
    m = _LABEL.match(text)
    return (text[m.end() :], True) if m else (text, False)


class Question:
    """What the checks need of a question."""

    def __init__(self, text: str | None) -> None:
        before, mark, after = _plain(text or "").partition("<video>")
        said, self.options = [], set()
        for line in (after if mark else before).split("\n"):
            m = _OPTION.match(line)
            if m:
                self.options.add(" ".join(words(m[1])))
            else:
                said.append(line)
        self.core = "\n".join(said).strip()
        self.sentences = [s for s in (" ".join(words(p)) for p in _SENTENCE.split(self.core)) if s.count(" ") >= 2]
        self.whole = (before + "\n" if mark else "") + self.core
        self.asked = frozenset(words(self.whole))
        self.words = " " + " ".join(words(self.whole)) + " "


def copies(found: list[str], question: Question) -> bool:
    """Whether the words are the question, with or without its lead-in, once or more, and nothing else."""
    while found and found[0] in ANNOUNCING:
        found = found[1:]
    if len(found) < 3 or not question.sentences:
        return False
    flat = " " + " ".join(found) + " "
    if not any(f" {s} " in flat for s in question.sentences):
        return False
    if flat in question.words:
        return True
    # Given back more than once, or with the lead-in after it: what is left without the sentences must be of the lead-in.
    rest = flat
    for s in sorted(question.sentences, key=len, reverse=True):
        while f" {s} " in rest:
            rest = rest.replace(f" {s} ", " ", 1)
    return rest.strip() == "" or (len(rest.split()) <= 12 and f" {rest.strip()} " in question.words)


def breaks_off(text: str, found: list[str], question: Question) -> bool:
    text = text.rstrip()
    if _ELLIPSIS.search(text) and len(found) >= 3:
        return True
    if _END.search(text):
        return False
    if " ".join(found) in question.options:
        return False
    if len(found) >= SENTENCE_WORDS and len(text.split()) >= SENTENCE_WORDS:
        return True
    return len(found) >= 3 and (found[-1] in DANGLING or text[-1:] in ",;:(-–—")


def own_content(text: str, asked: frozenset[str]) -> tuple[bool, bool]:
    """Whether the text has numbers, and whether it has names (capitalised words within a sentence), that the question doesn't have."""
    number = name = False
    shouting, last = text.upper() == text, 0
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t[0].isdigit():
            number = number or not _repeats(t, asked)
        elif not shouting and not name and t[0].isupper() and last and t not in _I and not _STOP.search(text, last, m.start()):
            name = not _repeats(t, asked)
        last = m.end()
    return number, name


def _repeats(token: str, asked: frozenset[str]) -> bool:
    return token.lower() in asked or all(w in asked for w in words(token))


def opening(text: str, most: int | None = None) -> str:
    """The words of an answer, or the first ``most`` of them, runs of numbers and of names (capitalised words after the first) masked."""
    out: list[str] = []
    shouting = text.upper() == text
    for k, t in enumerate(_TOKEN.findall(text)):
        if t[0].isdigit():
            t = "#"
        elif k and not shouting and t[0].isupper() and t not in _I:
            t = "_"
        else:
            t = t.lower()
        if t in ("_", "#") and out and out[-1] == t:
            continue
        out.append(t)
        if len(out) == most:
            break
    return " ".join(out)


_CHECKED = "origin string, rec_id long, field_name string, defect string, free boolean, bare boolean, opening string, prompt long, options array<string>"


def _check(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            for k in range(0, len(batch), 2000):
                yield _checked(batch.iloc[k : k + 2000], model)

    return run


def _checked(batch: pd.DataFrame, model: np.ndarray) -> pd.DataFrame:
    n = len(batch)
    defect: list[str | None] = [None] * n
    free, bare, start, prompt = [False] * n, [False] * n, [None] * n, [0] * n
    options: list[list[str] | None] = [None] * n
    texts, cores, todo = [], [], []
    known: dict[str | None, Question] = {}
    for k, (asked, answer) in enumerate(zip(batch["question"], batch["answer"])):
        if not isinstance(answer, str):
            defect[k] = "empty"
            continue
        text, labelled = body(answer)
        found = words(text)
        if not found:
            if not labelled:
                defect[k] = "empty"
            continue
        if len(found) <= 2 and " ".join(found) in NO_ANSWER:
            defect[k] = "empty"
            continue
        if len(found) < 3 and sum("一" <= c <= "鿿" for c in text) < 4:
            continue
        asked = asked if isinstance(asked, str) else None
        q = known.get(asked)
        if q is None:
            q = known[asked] = Question(asked)
            options[k] = [opening(o, OPENING_WORDS) for o in q.options if o.count(" ") >= LEAST_WORDS - 1]
        if copies(found, q):
            defect[k] = "copied_question"
            continue
        if len(found) >= LEAST_WORDS:
            # An option or its label is an answer; what the question says itself is no content.
            number, name = own_content(text, q.asked)
            bare[k] = not (number or " ".join(found) in q.options or (len(found[-1]) == 1 and found[-1] in "abcdefgh"))
            free[k] = bare[k] and not name
            start[k] = opening(text, RUN_WITHIN)
            prompt[k] = xxhash.xxh3_64_intdigest(opening(q.core, PROMPT_WORDS)) >> 1
        if breaks_off(text, found, q):
            defect[k] = "truncated"
        if len(found) >= 4 or not text.isascii():
            todo.append(k)
            texts.append(" ".join(text.lower().split()))
            cores.append(" ".join(q.whole.lower().split()))
    if todo:
        mine, asked = language._likelihoods(texts, model), language._likelihoods(cores, model)
        own = asked.argmax(axis=1)
        other = mine.max(axis=1) - mine[np.arange(len(todo)), own] > LANGUAGE_MARGIN
        clear = np.sort(asked, axis=1)
        other &= clear[:, -1] - clear[:, -2] > LANGUAGE_MARGIN
        for i in np.nonzero(other)[0]:
            defect[todo[i]] = "other_language"
    out = batch[["origin", "rec_id", "field_name"]].copy()
    return out.assign(defect=defect, free=free, bare=bare, opening=start, prompt=prompt, options=options)


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Band keys of each opening: MinHash over its words. ``back`` is the opening from its end, for a second order."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 61, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64)
    for batch in batches:
        keys, ids, texts, backs = [], [], [], []
        for at, text in zip(batch["id"], batch["opening"]):
            said = text.split()
            h = np.array([xxhash.xxh3_64_intdigest(w) for w in set(said) or {""}], np.uint64)
            with np.errstate(over="ignore"):
                low = ((h[:, None] * a + b) >> np.uint64(16)).min(axis=0)
            for band in range(BANDS):
                keys.append(xxhash.xxh3_64_intdigest(low[band * ROWS : (band + 1) * ROWS].tobytes(), band) >> 1)
            ids += [at] * BANDS
            texts += [text] * BANDS
            backs += [" ".join(reversed(said))] * BANDS
        yield pd.DataFrame({"key": keys, "id": ids, "opening": texts, "back": backs})


def in_common(x: list[str], y: list[str]) -> int:
    """The most words that stand in both in the same order (longest common subsequence, a bit per word of x)."""
    at: dict[str, int] = {}
    for k, w in enumerate(x):
        at[w] = at.get(w, 0) | 1 << k
    whole = (1 << len(x)) - 1
    left = whole
    for w in y:
        met = left & at.get(w, 0)
        left = (left + met | left - met) & whole
    return len(x) - left.bit_count()


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for s, t in zip(batch["s"], batch["t"]):
            s, t = s.split(), t.split()
            keep.append(in_common(s, t) >= SIMILARITY * max(len(s), len(t)))
        yield batch.loc[keep, ["x", "y"]]


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Connected components: id, root (the least id that ``links`` (x, y) lead to from id).

    Every round hooks each root to the least root that a link of its component leads to, then lets each node jump to the root of its
    root, so rounds grow with the logarithm of the longest chain. Nodes without links are their own roots.
    """
    both = cut(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = both.select(F.col("x").alias("id")).distinct().withColumn("root", F.col("id"))
    while True:
        seen = both.join(label.select(F.col("id").alias("y"), F.col("root").alias("far")), "y").join(label.select(F.col("id").alias("x"), "root"), "x")
        hooks = cut(seen.filter("far < root").groupBy(F.col("root").alias("old")).agg(F.min("far").alias("new")))
        if hooks.isEmpty():
            break
        hooked = label.join(hooks, label["root"] == hooks["old"], "left").select("id", F.coalesce("new", "root").alias("root"))
        jump = hooked.select(F.col("id").alias("root"), F.col("root").alias("far"))
        label = cut(hooked.join(jump, "root", "left").select("id", F.coalesce("far", "root").alias("root")))
    return nodes.join(label, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _subsequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct subsequences of each opening that hold at least SIMILARITY of its words."""
    for batch in batches:
        keys, ids = [], []
        for at, text in zip(batch["id"], batch["opening"]):
            said = text.split()
            if len(said) > MOST_WORDS:
                raise ValueError(f"an opening has {len(said)} words; links are exact for {MOST_WORDS} at most")
            found = {" ".join(kept) for k in range(math.ceil(SIMILARITY * len(said) - 1e-9), len(said) + 1) for kept in itertools.combinations(said, k)}
            keys += found
            ids += [at] * len(found)
            if len(keys) > 50_000:
                yield pd.DataFrame({"key": keys, "id": ids})
                keys, ids = [], []
        yield pd.DataFrame({"key": keys, "id": ids})


def shared_links(openings: DataFrame) -> DataFrame:
    """Links x, y that join all rows of ``openings`` (id, opening) of which SIMILARITY of the longer one's words stand in both in the same order.

    Such a pair has a subsequence of just so many words in common, which both have as a key. All openings with a key are
    similar to each other, as the key holds SIMILARITY of the words of each: a link of each to the least one joins them all, and none needs to be verified.
    """
    keyed = openings.select("id", "opening").mapInPandas(_subsequences, "key string, id long")
    least = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("y")).filter("n > 1").drop("n")
    return keyed.join(least, "key").filter("id != y").select(F.col("id").alias("x"), "y").distinct()


def opening_links(openings: DataFrame) -> DataFrame:
    """Links x, y between the rows of ``openings`` (id, opening; opening is distinct) that join whatever belongs together.

    In each band bucket an opening is held against the bucket's least one and its neighbours in the orders of the openings read from the start and from the end.
    Buckets are never expanded to all their pairs, and crowded ones are cut into parts that keep the least one in common. What is similar without
    meeting there is joined by ``shared_links``.
    """
    from pyspark.sql import Window

    keyed = cut(openings.select("id", "opening").mapInPandas(_signatures, "key long, id long, opening string, back string"))
    own = F.struct("id", "opening")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(own).alias("least")).filter("n > 1")
    keyed = keyed.join(buckets, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / HOT_BUCKET)))
    part = Window.partitionBy("key", "part")
    beside = keyed.select("id", "opening", "least", F.lag(own).over(part.orderBy("opening")).alias("before"), F.lag(own).over(part.orderBy("back")).alias("behind"))
    beside = beside.select("id", "opening", F.explode(F.array("least", "before", "behind")).alias("y"))
    pairs = beside.filter("y is not null and id != y.id").select(F.greatest("id", "y.id").alias("x"), F.least("id", "y.id").alias("y"), F.col("opening").alias("s"), F.col("y.opening").alias("t"))
    return pairs.dropDuplicates(["x", "y"]).mapInPandas(_verify, "x long, y long").unionByName(shared_links(openings))


def opening_clusters(openings: DataFrame) -> DataFrame:
    """Clusters of the distinct values of the column opening: opening, cluster (the least opening that verified links lead to)."""
    text = cut(openings.select("opening").filter("opening is not null").distinct().withColumn("id", F.monotonically_increasing_id()))
    found = text.join(components(text.select("id"), cut(opening_links(text))), "id")
    return found.join(found.groupBy("root").agg(F.min("opening").alias("cluster")), "root").select("opening", "cluster")


def _first(n: int):
    return F.array_join(F.slice(F.split("opening", " "), 1, n), " ")


def _runs():
    """The distinct runs of RUN_WORDS words of the column opening."""
    said = F.split("opening", " ")
    last = F.size(said) - RUN_WORDS
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.array_join(F.slice(said, k + 1, RUN_WORDS), " ")))).otherwise(F.array().cast("array<string>"))


def refusal_signs(checked: DataFrame) -> DataFrame:
    """What marks a refusal: the openings of templates, and runs of them. One column: sign."""
    openings = checked.filter("opening is not null").withColumn("opening", _first(OPENING_WORDS)).groupBy("opening").agg(
        F.count("*").alias("n"), F.count_if("free").alias("free"), F.count_if("bare").alias("bare"), F.hll_sketch_agg("prompt").alias("prompts")
    )
    openings = cut(openings)
    options = checked.select(F.explode("options").alias("opening")).distinct()
    seeds = openings.filter("free > 0").join(options, "opening", "left_anti")
    whole = seeds.join(opening_clusters(seeds), "opening")
    refusing = whole.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("free").alias("free"), F.hll_sketch_estimate(F.hll_union_agg("prompts")).alias("p"))
    refusing = refusing.filter((F.col("p") >= PROMPTS) & (F.col("free") >= FREE * F.col("n"))).select("cluster")
    templates = cut(whole.join(refusing, "cluster", "left_semi").select("opening"))
    runs = templates.select(F.explode(_runs()).alias("sign")).distinct()
    used = openings.select("n", "bare", F.explode(_runs()).alias("sign")).join(runs, "sign", "left_semi").groupBy("sign").agg(F.sum("n").alias("n"), F.sum("bare").alias("bare"))
    return templates.select(F.col("opening").alias("sign")).unionByName(used.filter(F.col("bare") >= BARE * F.col("n")).select("sign")).distinct()


def defective_answers(answers: DataFrame, model: np.ndarray) -> DataFrame:
    """The defective ones of ``answers`` (origin, rec_id, field_name, question, answer): origin, rec_id, field_name, defect.

    One defect per answer, the first that holds of empty, copied_question, refusal, other_language, truncated. ``model`` is that of the
    language operator. Rows without rec_id are left out; a null answer is empty; without a question neither copies nor languages are looked for; repeated rows
    count each; an empty table gives an empty result; other columns are ignored.
    """
    sent = answers.sparkSession.sparkContext.broadcast(model)
    rows = answers.select("origin", F.col("rec_id").cast("long").alias("rec_id"), "field_name", "question", "answer").filter("rec_id is not null")
    checked = cut(rows.mapInPandas(_check(sent), _CHECKED).withColumn("row", F.monotonically_increasing_id()))
    # Only answers without numbers of their own can be refusals; the others stay where they are.
    asks = F.col("opening").isNotNull() & F.col("bare")
    shown = F.array_union(F.array(_first(OPENING_WORDS)), _runs())
    refused = checked.filter(asks).select("row", F.explode(shown).alias("sign")).join(refusal_signs(checked), "sign", "left_semi").select("row").distinct()
    kept = ["origin", "rec_id", "field_name", "defect"]
    judged = checked.filter(asks).join(refused.withColumn("refuses", F.lit(True)), "row", "left").select(*kept, "refuses")
    judged = checked.filter(~asks).select(*kept, F.lit(None).cast("boolean").alias("refuses")).unionByName(judged)
    defect = F.when(F.col("defect").isin("empty", "copied_question"), F.col("defect")).when(F.col("refuses"), "refusal").otherwise(F.col("defect"))
    return judged.select("origin", "rec_id", "field_name", defect.alias("defect")).filter("defect is not null")
