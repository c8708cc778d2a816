"""Pages of repeated keywords, links, tags or products, found by labelling their lines.

Lines (long ones cut into sentence-like parts) emit a few discrete features: shares of links, hashtags, prices and
disguised letters, repetition, separators, sentence ends, signs of records, and how far their words belong to list
lines. A hidden Markov model with the states prose, record, link list, tag list and menu labels each line; a page
is flagged when lines of the last three hold more than a given share of its text. Records are what logs,
settings, code and tables consist of; they are no prose, but no lists put there to be found either.

The model is trained on a bounded sample of labelled documents, by hard EM from plain seeds; the labels themselves only place the
threshold. Everything else covers every document whole.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.session import c

STATES = ("prose", "record", "links", "tags", "menu")
LISTS = (2, 3, 4)
#: Labelled documents the model is trained on, at most, and the characters they have together, at most; whole texts, in the
#: order of a hash of their keys. Classification has no such bound.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 4_000, 64_000_000
PART_WORDS, LONGEST_PART = 14, 36
EM_ROUNDS = 5
#: Weight of a uniform emission in every state, so that no single feature rules a state out.
FLOOR = 0.003
#: Exponent of the emissions, below 1 since the features are not independent.
TEMPER = 0.6
#: Share of list text above which a page is flagged, where labels don't place it.
THRESHOLD = 0.5
#: Characters of texts that are labelled at once.
AT_ONCE = 2_000_000

ZERO_WIDTH = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
ZERO_WIDTH_LETTERS = re.compile("(?:\\w\u200b){3}")
LINK = re.compile(
    r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\n]*\)|https?://[^\s,;<>\"']+|www\.[^\s,;<>\"']+"
    r"|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,8}/[^\s,;<>\"']*|(?<![\w<.])/[a-z0-9_-]+(?:[/?.][\w./?=&-]*)?",
    re.IGNORECASE,
)
HASHTAG = re.compile(r"(?<!\w)#(?=\w)[\w-]+")
PRICE = re.compile(r"(?<![\d.:])\d{1,4}[.,]\d{2}(?![\d.%:])")
#: Cheap sign that a part may have a price at all.
MAYBE_PRICE = re.compile(r"\d[.,]\d\d")
LIST_SIGNS = "★|•/;,·»"
ASCII_SIGNS = "".join(x for x in LIST_SIGNS if x.isascii())
DASHES = "-–—"
DASH = re.compile(rf"(?<=\s)[{DASHES}](?=\s)")
SEPARATOR = re.compile(rf"[{LIST_SIGNS}]|{DASH.pattern}")
RECORD = re.compile(
    r"\s*(?:[{}]|\||<\d+>\d|\[\w+\]\s|\$\s|```|\d{1,2}:\d\d(?::\d\d)?|[\w.-]+\s+\d\d:\d\d>|\w[\w.-]*\s*[=:]\s|def |for |if |yield |return |[\w.]+\s+[—|-]\s)"
)
LEVELS = ("INFO", "WARN", "ERROR", "DEBUG", "TRACE")
LEVEL = re.compile(rf"\b(?:{'|'.join(LEVELS)})\b")
SENTENCE_ENDS = tuple(".!?。！？…")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
FULL_STOP = re.compile("(?<=[。！？])")
#: Letters that spam writes as digits and signs.
LOOKALIKES = str.maketrans({"@": "a", "0": "o", "3": "e", "1": "i", "$": "s", "4": "a"})
DISGUISED = re.compile(r"(?<![\w@.:/-])(?=[\w@]*[^\W\d_])(?=[\w@]*[@031])[^\W_@]*(?:[^\W\d_][@031]|[@031][^\W\d_])[\w@]*(?![\w.:/-])")


#: Cheap sign that a part may have disguised letters at all.
MAYBE_DISGUISED = re.compile(r"[^\W\d_][@031]|[@031][^\W\d_]")


#: Rising edges of the features' values: a value falls into the bin of as many edges as it exceeds.
LINK_EDGES, TAG_EDGES, REPEAT_EDGES, SEPARATOR_EDGES, RARE_EDGES = (0, 0.2, 0.4, 0.65), (0, 0.3), (0.1, 0.22, 0.4, 0.6), (0, 0.08, 0.18, 0.34), (0, 0.08)
SHARED_EDGES, WORD_EDGES, PAIR_EDGES, COUNT_EDGES = (0.05, 0.3, 0.6), (2, 6, 12, 22), (0, 0.2, 0.3, 0.45), (0, 1, 3)
LIST_WORD_EDGES = (-1.6, -0.9, -0.3, 0.3, 0.9, 1.6)


@dataclass
class Part:
    features: list[int]
    words: list[str]
    size: int


#: Values each feature can take; the last is how list-like the words are, filled in by the model.
VALUES = (5, 3, 6, 5, 3, 3, 2, 2, 4, 5, 5, 4, 8)
_FIRST = np.concatenate(([0], np.cumsum(VALUES)[:-1]))
#: So many scraps in a row, or equal ones in a page, are a list and not headings.
SCRAPS = 4


def split_parts(text: str) -> list[str]:
    """Lines; longer ones cut after sentence ends, or where a part gets too long. Nothing is lost but blank space."""
    out = []
    for line in text.splitlines():
        if not line.isascii() and FULL_STOP.search(line) and CJK.search(line):  # scripts without spaces: sentence by sentence
            out += [x for x in FULL_STOP.split(line) if x.strip()]
            continue
        tokens = line.split()
        if len(tokens) <= LONGEST_PART:
            if tokens:
                out.append(line)
            continue
        start = 0
        for i, t in enumerate(tokens):
            n = i + 1 - start
            if n >= LONGEST_PART or (n >= PART_WORDS and t[-1] in ".!?。！？"):
                out.append(" ".join(tokens[start : i + 1]))
                start = i + 1
        if start < len(tokens):
            out.append(" ".join(tokens[start:]))
    return out


def _words(text: str) -> list[str]:
    if text.isascii() or not CJK.search(text):
        return WORD.findall(text)
    found = []
    for w in WORD.findall(text):
        if CJK.search(w):
            found += [w[i : i + 2] for i in range(0, max(1, len(w) - 1))]
        else:
            found.append(w)
    return found


def _is_record(part: str) -> bool:
    return RECORD.match(part) is not None or (any(map(part.__contains__, LEVELS)) and LEVEL.search(part) is not None)


def describe(text: str) -> list[Part]:
    """The parts of a text with their features."""
    parts, before, fenced = [], set(), False
    for raw in split_parts(text if text.isascii() else unicodedata.normalize("NFKC", text)):
        part = raw if raw.isascii() else ZERO_WIDTH.sub("", raw)
        disguised = 3 if part is not raw and ZERO_WIDTH_LETTERS.search(raw) else 0
        spaced = part.split()
        size = sum(map(len, spaced))
        if not size:
            continue
        fence = part.lstrip().startswith("```")
        fenced ^= fence
        links = LINK.findall(part) if "/" in part or "www." in part or "](" in part else []
        link_chars = sum(len(x) - x.count(" ") for x in links)
        rest = LINK.sub(" ", part) if links else part
        if ("0" in rest or "1" in rest or "3" in rest or "@" in rest) and MAYBE_DISGUISED.search(rest) is not None and (hidden := len(DISGUISED.findall(rest))):
            disguised += hidden
            folded = DISGUISED.sub(lambda m: m.group().translate(LOOKALIKES), rest).casefold()
        else:
            folded = rest.casefold()
        tags = len(HASHTAG.findall(rest)) if "#" in rest else 0
        words = _words(folded)
        n_words = len(words)
        n = n_words or 1
        distinct = set(words)
        tokens = max(1, len(rest.split()) if links else len(spaced), n // 2)
        plain = rest.isascii()
        seps = sum(map(rest.count, ASCII_SIGNS if plain else LIST_SIGNS)) + (len(DASH.findall(rest)) if "-" in rest or not plain and ("–" in rest or "—" in rest) else 0)
        items = [x for x in SEPARATOR.split(folded) if x.strip()] if seps > 1 else ()
        seps += max(0, len(links) - 1)
        pair = 1
        pairs = list(zip(words, words[1:])) if n - len(distinct) > 1 else ()  # a pair comes again with both its words
        if len(set(pairs)) < len(pairs) and (folded.isascii() or not CJK.search(folded)):
            counts = Counter(pairs).values()
            pair = sum(x for x in counts if x > 2) or 2
        repeated_items = 1 - len({x.strip() for x in items}) / len(items) if len(items) > 2 else 0.0
        features = [
            bisect_left(LINK_EDGES, link_chars / size),
            bisect_left(TAG_EDGES, tags / tokens) if tags else 0,
            5 if n_words < 4 else bisect_left(REPEAT_EDGES, max(1 - len(distinct) / n, repeated_items)),
            bisect_left(SEPARATOR_EDGES, seps / (tokens + len(links))) if seps else 0,
            bisect_left(RARE_EDGES, len(PRICE.findall(rest)) / tokens) if MAYBE_PRICE.search(rest) else 0,
            bisect_left(RARE_EDGES, disguised / tokens) if disguised else 0,
            int(part.rstrip().rstrip("'\")]")[-1:] in SENTENCE_ENDS),
            int(fenced or fence or (link_chars < 0.4 * size and _is_record(part))),
            bisect_left(SHARED_EDGES, len(distinct & before) / max(1, len(distinct))),
            bisect_left(WORD_EDGES, n_words),
            bisect_left(PAIR_EDGES, 2 * pair / n) if pair > 1 else 0,
            bisect_left(COUNT_EDGES, len(links)) if links else 0,
        ]
        parts.append(Part(features, words, size))
        before = distinct
    often = Counter(tuple(p.words) for p in parts if 0 < len(p.words) < 6)
    for p in parts:
        if often[tuple(p.words)] >= SCRAPS:
            p.features[2] = 4
    return parts


def _scraps(x: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Which parts tell nothing by themselves: headings and the like, a few words without any sign of a list."""
    scrap = (x[:, 2] == 5) & (x[:, [0, 1, 4, 5]] == 0).all(axis=1)
    new = np.ones(len(x), dtype=bool)
    new[1:] = (scrap[1:] != scrap[:-1]) | (page[1:] != page[:-1])
    run = np.cumsum(new) - 1
    return scrap & (np.bincount(run)[run] < SCRAPS)


def _seed(p: Part) -> int:
    link, tag, repeat, sep, price, disguise, end, record = p.features[:8]
    if link >= 3:
        return 2
    if tag == 2:
        return 3
    if price == 2 or disguise == 2 or p.features[10] >= 3 or (repeat in (3, 4) and not (record and repeat == 3)) or (sep >= 3 and not end and not record):
        return 4
    return 1 if record else 0


class LineModel:
    """Hidden Markov model over parts, with independent discrete emissions."""

    def __init__(self) -> None:
        k = len(STATES)
        self.start = np.full(k, -np.log(k))
        self.step = np.full((k, k), -np.log(k))
        self.flat = np.zeros((sum(VALUES), k))  # log emissions of every value of every feature, tempered
        self.lists: dict[str, float] = {}
        self.threshold = THRESHOLD

    def _word_bin(self, words: list[str]) -> int:
        if not words:
            return 7
        s = sum(map(self.lists.get, words, repeat(0.0))) / len(words)
        return bisect_left(LIST_WORD_EDGES, s)

    def label(self, pages: list[list[Part]]) -> list[np.ndarray]:
        """The likeliest states of the parts of each page. All pages take a step of the way together."""
        sizes = np.array([len(p) for p in pages], dtype=np.int64)
        if not sizes.sum():
            return [np.empty(0, dtype=np.int8) for _ in pages]
        x = np.array([[*p.features, self._word_bin(p.words)] for parts in pages for p in parts])
        score = self.flat[x + _FIRST].sum(axis=1)
        # headings and other scraps of a few words tell nothing by themselves: their neighbours decide
        score[_scraps(x, np.repeat(np.arange(len(pages)), sizes))] = 0.0
        first = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        order = order[: int((sizes > 0).sum())]
        first, length = first[order], sizes[order]
        longest = int(length[0])
        active = np.searchsorted(-length, -np.arange(longest), "left")  # pages longer than t
        best, back = self.start + score[first], np.zeros((len(x), len(STATES)), dtype=np.int8)
        for t in range(1, longest):
            k = active[t]
            way = best[:k, :, None] + self.step
            at = way.argmax(axis=1)
            back[first[:k] + t] = at
            best[:k] = np.take_along_axis(way, at[:, None, :], 1)[:, 0] + score[first[:k] + t]
        states = np.empty(len(x), dtype=np.int8)
        now = best.argmax(axis=1)
        states[first + length - 1] = now
        for t in range(longest - 1, 0, -1):
            k = active[t]
            now[:k] = back[first[:k] + t, now[:k]]
            states[first[:k] + t - 1] = now[:k]
        return np.split(states, np.cumsum(sizes)[:-1])

    def list_shares(self, texts: list[str | None]) -> list[float]:
        """The share of each text's characters that lie in list lines."""
        pages = [describe(t or "") for t in texts]
        shares = []
        for parts, states in zip(pages, self.label(pages)):
            size = np.array([p.size for p in parts], dtype=np.int64)
            shares.append(float(size[np.isin(states, LISTS)].sum() / size.sum()) if len(size) else 0.0)
        return shares

    def list_share(self, text: str | None) -> float:
        return self.list_shares([text])[0]

    def _estimate(self, pages: list[list[Part]], states: list) -> None:
        k = len(STATES)
        start, step = np.ones(k), np.ones((k, k)) + 5 * np.eye(k)
        emit = [np.full((k, v), 0.5) for v in VALUES]
        legit, lists = Counter(), Counter()
        for parts, ss in zip(pages, states):
            for p, s in zip(parts, ss):
                (lists if s in LISTS else legit).update(p.words)
        a, b = sum(legit.values()) + 1.0, sum(lists.values()) + 1.0
        self.lists = {
            w: float(np.clip(np.log((lists[w] + 0.5) / b) - np.log((legit[w] + 0.5) / a), -3, 3))
            for w in legit.keys() | lists.keys() if legit[w] + lists[w] >= 3
        }
        for parts, ss in zip(pages, states):
            if not parts:
                continue
            start[ss[0]] += 1
            np.add.at(step, (ss[:-1], ss[1:]), 1)
            for p, s in zip(parts, ss):
                for f, v in enumerate([*p.features, self._word_bin(p.words)]):
                    emit[f][s, v] += 1
        self.start = np.log(start / start.sum())
        self.step = np.log(step / step.sum(axis=1, keepdims=True))
        emit = [np.log((1 - FLOOR) * e / e.sum(axis=1, keepdims=True) + FLOOR / e.shape[1]) for e in emit]
        self.flat = TEMPER * np.concatenate(emit, axis=1).T

    def fit(self, texts: list[str], labels: list[float | None]) -> LineModel:
        """Hard EM from the seeds; then the threshold that agrees with most labels, near THRESHOLD unless they weigh against it."""
        pages = [describe(t or "") for t in texts]
        states = [[_seed(p) for p in parts] for parts in pages]
        self._estimate(pages, states)
        for _ in range(EM_ROUNDS):
            states = self.label(pages)
            self._estimate(pages, states)
        known = [(p, s, y) for p, s, y in zip(pages, self.label(pages), labels) if y is not None and p]
        shares = np.array([sum(x.size for x, k in zip(p, s) if k in LISTS) / sum(x.size for x in p) for p, s, _ in known])
        y = np.array([y > 0.5 for *_, y in known], dtype=bool)
        grid = np.linspace(0.4, 0.6, 21)
        # a step away from THRESHOLD costs as much as 0.4 % of the labels and one label more
        agree = np.array([((shares > t) == y).sum() - (0.02 * len(y) + 5) * abs(t - THRESHOLD) for t in grid])
        self.threshold = float(grid[agree.argmax()])
        return self


def sampled(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "spam") -> DataFrame:
    """(t, y): the bounded sample of labelled documents, whole texts with the mean of their labels.

    Keys and lengths are picked first; only the picked documents' texts move. Null labels and texts without characters
    are left out.
    """
    mean = labels.where(c(label).isNotNull() & c(key).isNotNull()).groupBy(c(key).alias("k")).agg(F.avg(c(label).cast("double")).alias("y"))
    docs = documents.select(c(key).alias("k"), c(text).alias("t"))
    lengths = docs.where(F.length("t") > 0).select("k", F.length("t").alias("n")).join(mean, "k").orderBy(F.xxhash64("k"), "k").limit(SAMPLE_DOCUMENTS)
    upto = F.sum("n").over(W.orderBy(F.xxhash64("k"), "k").rowsBetween(W.unboundedPreceding, 0))
    picked = lengths.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_CHARS).select("k", "y")
    return docs.join(picked, "k").orderBy(F.xxhash64("k"), "k", "t").select("t", "y")


def train(documents: DataFrame, labels: DataFrame | None, key: str = "doc_id", text: str = "text", label: str = "spam") -> LineModel:
    """A model from the sample of labelled documents; without any, one that knows nothing and flags nothing."""
    if labels is None:
        return LineModel().fit([], [])
    chosen = sampled(documents, labels, key, text, label).toPandas()
    known = [None if pd.isna(y) or y == 0.5 else float(y) for y in chosen["y"]]
    return LineModel().fit(chosen["t"].tolist(), known)


def flag(documents: DataFrame, model: LineModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, list_share double, flagged boolean) of every document; null, empty and blank texts are not flagged."""
    kind = dict(documents.dtypes)[key]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["t"]]
            share: list[float] = []
            held, size = [], 0
            for t in texts:
                held.append(t)
                size += len(t or "")
                if size >= AT_ONCE:
                    share += m.list_shares(held)
                    held, size = [], 0
            share += m.list_shares(held)
            yield pd.DataFrame({"k": b["k"], "list_share": share, "flagged": [s > m.threshold for s in share]})

    # texts are dealt out evenly by their keys: classifying costs far more than moving them, and files are few and uneven
    rows = documents.select(c(key).alias("k"), c(text).alias("t")).repartition(c("k"))
    out = rows.mapInPandas(run, f"k {kind}, list_share double, flagged boolean")
    return out.withColumnRenamed("k", key)
