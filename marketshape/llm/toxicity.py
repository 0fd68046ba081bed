"""Abusive, hateful or sexual language: class-conditional Kneser-Ney models over disguise-tolerant words."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small

# Letters of other scripts that look like Latin ones, digits and signs read as letters.
LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝкмтвнАЕОРСУХІЈЅКМТВНαονρτυικ", "aeopcyxijshdqwkmtbhaeopcyxijskmtbhaovptuik")
LEET = str.maketrans("013457@$!|", "oieastasil")
INVISIBLE = re.compile("[­᠎​-‏‪-‮⁠-⁤︀-️﻿]")

SPELT = re.compile(r"(?<![\w.])(?:[^\W\d_](?P<gap>[ .\-_*]))(?:[^\W\d_](?P=gap))+[^\W\d_](?!\w)")
SPLIT = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|[\r\n]+|<[^<>]{1,80}>|(?<=\W)(?:#|//|--)\s")
WORD = re.compile(r"https?\S+|hxxps?\S+|@\w+|\"|[\w*@$!|]*[^\W_][\w*@$|]*(?:['’][^\W\d_]+)?")
SPOILT = re.compile("[ÃÂ][\u0080-¿]|â[\u0080-⃿]")
LONG = re.compile(r"([^\W\d_])\1{2,}")


def plain(text: str) -> str:
    """The text with wrong decodings undone, invisible signs gone, look-alikes as Latin letters, in lower case."""
    if SPOILT.search(text):
        for codec in ("latin-1", "cp1252"):
            try:
                text = text.encode(codec).decode("utf-8")
                break
            except UnicodeError:
                pass
    text = INVISIBLE.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(w.translate(LOOKALIKES) if any("Ͱ" <= ch <= "ԯ" for ch in w) and (any("a" <= ch.lower() <= "z" for ch in w) or all(ord(ch) > 127 and ch.translate(LOOKALIKES) != ch for ch in w if ch.isalpha())) else w for w in re.split(r"(\W+)", text))
    return text.lower()


class Words:
    """Turns a text into segments of words, reading disguised words as words of a known lexicon."""

    def __init__(self, lexicon: Iterable[str]):
        self.known = frozenset(lexicon)
        self.cache: dict[str, str] = {}
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for w in sorted(self.known):
            self.by_length[len(w)].append(w)

    def _one_gap(self, gap: re.Match) -> str:
        letters = re.sub(r"[ .\-_*]", "", gap.group(0))
        best: list[tuple[int, list[str]] | None] = [(0, [])] + [None] * len(letters)  # fewest words
        for z in range(1, len(letters) + 1):
            for a in range(max(0, z - 24), z):
                if best[a] is not None and letters[a:z] in self.known and (best[z] is None or best[a][0] + 1 < best[z][0]):
                    best[z] = (best[a][0] + 1, [*best[a][1], letters[a:z]])
        return " ".join(best[-1][1]) if best[-1] else letters

    def word(self, w: str) -> str:
        got = self.cache.get(w)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.cache[w] = self._word(w)
        return got

    def _word(self, w: str) -> str:
        if w in self.known or w == '"':
            return w
        if w.startswith(("http", "hxxp")):
            return "<url>"
        if w[0] == "@" and len(w) > 1 and "_" in w:
            return "<at>"
        if any(ch.isdigit() or ch in "@$!|" for ch in w):
            if "_" in w:
                return "<id>"
            r = w.translate(LEET)
            found = self._near(r) if not w.isdigit() or r in self.known else None
            return found or ("<num>" if w.isdigit() else r if sum(ch.isalpha() for ch in w) * 2 >= len(w) else "<id>")
        if "_" in w:
            return "<id>"
        return self._near(w) or LONG.sub(r"\1", w).replace("*", "")

    def _near(self, w: str) -> str | None:
        """A known word that is ``w`` with letters repeated, starred out or two neighbours swapped."""
        if w in self.known:
            return w
        if LONG.search(w):
            for by in (r"\1", r"\1\1"):
                if (x := LONG.sub(by, w)) in self.known:
                    return x
        if "*" in w and any(ch.isalpha() for ch in w):
            shape = re.compile("".join(".{1,2}" if p[0] == "*" else re.escape(p) for p in re.findall(r"\*+|[^*]+", w)))
            for n in (len(w), len(w) - 1, len(w) + 1):
                for x in self.by_length.get(n, ()):
                    if shape.fullmatch(x):
                        return x
        if len(w) > 3:
            for i in range(len(w) - 1):
                if w[i] != w[i + 1] and (x := w[:i] + w[i + 1] + w[i] + w[i + 2 :]) in self.known:
                    return x
        return None

    def segments(self, text: str) -> Iterator[list[str]]:
        """The words of every sentence or line that has any."""
        text = plain(text)
        for s in SPLIT.split(text):
            if not s:
                continue
            if len(s) > 4:
                s = SPELT.sub(self._one_gap, s)
            words = [self.word(w) for w in WORD.findall(s)]
            if words:
                yield words


def grams(words: list[str]) -> Iterator[str]:
    """The trigrams of a segment with its bounds, words joined by blanks."""
    w = ["<s>", "<s>", *words, "</s>"]
    for i in range(2, len(w)):
        yield f"{w[i - 2]} {w[i - 1]} {w[i]}"


class KneserNey:
    """Interpolated trigram models of two classes whose last backoff, words by the number of
    words they follow anywhere, is shared. ``follow``: that number for the words asked for,
    its sum over all words, and how many words there are; else as in either class."""

    def __init__(self, counts: dict[str, dict[str, float]], discount: float = 0.75, follow: tuple[dict[str, int], int, int] | None = None):
        if follow is None:
            pooled: dict[str, set] = defaultdict(set)
            for c in counts.values():
                for g in c:
                    _, b, w = g.split(" ")
                    pooled[w].add(b)
            follow = {w: len(x) for w, x in pooled.items()}, sum(map(len, pooled.values())), len(pooled)
        after, total, words = follow
        total = total or 1
        self.size = words + 1
        self.shared = {w: x / total for w, x in after.items()}
        self.mass = min(0.9, discount * words / total)
        self.floor = self.mass / (self.size * 4)
        self.of = {k: self._fit(c, discount) for k, c in counts.items()}

    @staticmethod
    def _fit(c: dict[str, float], discount: float) -> tuple:
        tri: dict[str, float] = {}
        h2: Counter = Counter()
        n2: Counter = Counter()
        after: dict[str, set] = defaultdict(set)
        for g, x in c.items():
            if x <= 0:
                continue
            tri[g] = x
            a, b, w = g.split(" ")
            h2[f"{a} {b}"] += x
            n2[f"{a} {b}"] += min(1.0, x)
            after[f"{b} {w}"].add(a)
        bi = {k: float(len(v)) for k, v in after.items()}
        h1: Counter = Counter()
        n1: Counter = Counter()
        one: Counter = Counter()
        for k, x in bi.items():
            b, w = k.split(" ")
            h1[b] += x
            n1[b] += 1
            one[w] += 1
        total = float(sum(one.values())) or 1.0
        return tri, h2, n2, bi, h1, n1, one, total, discount

    def p(self, cls: str, a: str, b: str, w: str) -> float:
        tri, h2, n2, bi, h1, n1, one, total, d = self.of[cls]
        base = max(self.shared.get(w, 0.0) * (1 - self.mass), 0.0) + self.floor
        p = max(one.get(w, 0) - d, 0.0) / total + (d * len(one) / total if one else 1.0) * base
        if h := h1.get(b):
            p = max(bi.get(f"{b} {w}", 0.0) - d, 0.0) / h + d * n1[b] / h * p
        if h := h2.get(ab := f"{a} {b}"):
            x = tri.get(f"{ab} {w}", 0.0)
            p = max(x - d * min(1.0, x), 0.0) / h + d * n2[ab] / h * p
        return p


def log_ratios(counts: DataFrame, discount: float = 0.75) -> DataFrame:
    """(gram, x): ``KneserNey``'s ln p(harmful) / p(ordinary) of every trigram of (gram, h, o), its counts in both classes.

    History and continuation counts are aggregations over all rows, joined back to them.
    A trigram in neither class still counts for the shared backoff.
    """
    both = ("h", "o")
    part = F.split("gram", " ")
    t = counts.select("gram", part[0].alias("a"), part[1].alias("b"), part[2].alias("w"), *both)
    some = lambda c: F.sum((F.col(c) > 0).cast("bigint"))
    history = t.groupBy("a", "b").agg(*(F.sum(c).alias(f"h2{c}") for c in both), *(F.sum(F.least(F.lit(1.0), c)).alias(f"n2{c}") for c in both))
    pairs = cut(t.groupBy("b", "w").agg(*(some(c).alias(f"bi{c}") for c in both)))
    middle = pairs.groupBy("b").agg(*(F.sum(f"bi{c}").alias(f"h1{c}") for c in both), *(some(f"bi{c}").alias(f"n1{c}") for c in both))
    last = pairs.groupBy("w").agg(*(some(f"bi{c}").alias(f"one{c}") for c in both), F.count(F.lit(1)).alias("pooled"))
    z = last.agg(F.sum("pooled").alias("total"), F.count(F.lit(1)).alias("words"), *(F.sum(f"one{c}").alias(f"sum{c}") for c in both), *(some(f"one{c}").alias(f"len{c}") for c in both)).first()
    total = float(z["total"] or 1)
    mass = min(0.9, discount * z["words"] / total)
    base = F.col("pooled") * ((1 - mass) / total) + mass / ((z["words"] + 1) * 4)
    less = lambda c: F.greatest(F.col(c) - discount, F.lit(0.0))

    def backed(c: str) -> Column:
        """p of the word after one word."""
        every = float(z[f"sum{c}"] or 1)
        p = less(f"one{c}") / every + (discount * z[f"len{c}"] / every if z[f"len{c}"] else 1.0) * base
        return F.when(F.col(f"h1{c}") > 0, less(f"bi{c}") / F.col(f"h1{c}") + discount * F.col(f"n1{c}") / F.col(f"h1{c}") * p).otherwise(p)

    def whole(c: str) -> Column:
        p, h = F.col(f"p{c}"), F.col(f"h2{c}")
        return F.when(h > 0, (F.col(c) - discount * F.least(F.lit(1.0), c)) / h + discount * F.col(f"n2{c}") / h * p).otherwise(p)

    pairs = pairs.join(middle, "b").join(last, "w").select("b", "w", *(backed(c).alias(f"p{c}") for c in both))
    return t.join(history, ["a", "b"]).join(pairs, ["b", "w"]).select("gram", F.ln(whole("h") / whole("o")).alias("x"))


class Scorer:
    """Length-normalised log-likelihood ratio of harmful against ordinary, in nats a word."""

    def __init__(self, model: KneserNey, prior_words: float = 2.0):
        self.model, self.extra, self.cache = model, prior_words, {}

    def gram(self, g: str) -> float:
        x = self.cache.get(g)
        if x is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            a, b, w = g.split(" ")
            x = self.cache[g] = math.log(self.model.p("harmful", a, b, w) / self.model.p("ordinary", a, b, w))
        return x

    def segment(self, words: list[str]) -> float:
        return sum(map(self.gram, grams(words))) / (len(words) + 1 + self.extra)


def _binomial_tails(k: int, n: int, p: float) -> float:
    """P(X >= k) for X of n draws."""
    if k <= 0:
        return 1.0
    if n > 400:  # normal approximation with continuity correction
        return 0.5 * math.erfc((k - 0.5 - n * p) / math.sqrt(2 * n * p * (1 - p)))
    q, s = (1 - p) ** n, 0.0
    for i in range(k):
        s += q
        q *= (n - i) / (i + 1) * p / (1 - p)
    return max(0.0, 1.0 - s)


def _count(rows: Iterable[list[str]]) -> Counter:
    return Counter(g for words in rows for g in grams(words))


def fit_labels(snippets: list[tuple[list[list[str]], bool]], corpus: dict[str, float], follow: tuple[dict[str, int], int, int] | None = None) -> tuple[Counter, Counter]:
    """(harmful counts, ordinary counts) from judged snippets and usual corpus trigrams.

    A snippet judged harmful may hold ordinary sentences too. Those of one segment count
    as they are; of the others only the segment that the model so far finds worst, and
    those it is sure of, in three rounds. Wrong labels are few and smoothed away.
    """
    ordinary = _count(s for segments, bad in snippets if not bad for s in segments)
    usual = Counter(ordinary)
    usual.update(corpus)
    keep = [segments[0] for segments, bad in snippets if bad and len(segments) == 1]
    model = KneserNey({"harmful": _count(keep), "ordinary": usual}, follow=follow)
    for _ in range(3):
        score = Scorer(model)
        keep = []
        for segments, bad in snippets:
            if bad and segments:
                v = [score.segment(s) for s in segments]
                keep += [s for s, x in zip(segments, v, strict=True) if (x == max(v) and x > 0.2) or x > 0.7]
        model = KneserNey({"harmful": _count(keep), "ordinary": usual}, follow=follow)
    return _count(keep), ordinary


def _occurrences(segments: DataFrame, *keep: str) -> DataFrame:
    """Every trigram of the segments (words joined by blanks) as a row, with the columns ``keep``: those of ``grams``."""
    w = F.split("words", " ")
    start, end, beside = F.array(F.lit("<s>")), F.array(F.lit("</s>")), lambda x, y: F.concat(x, F.lit(" "), y)
    g = F.zip_with(F.zip_with(F.concat(start, start, w), F.concat(start, w), beside), F.concat(w, end), beside)  # the longest leaves a null
    return segments.select(*keep, F.explode(g).alias("gram")).where("gram is not null")


def of_weight(counts: DataFrame, c: str, words: float) -> DataFrame:
    """``counts`` with its column ``c`` scaled to a sum of ``words``, if it has more."""
    total = counts.agg(F.sum(c)).first()[0] or 0
    return counts.withColumn(c, F.col(c) * min(1.0, words / max(1.0, total)))


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.6, max_labels: int = 50_000, usual: float = 2e-5, seed: float = 1.5) -> DataFrame:
    """(doc_id, source, score, flagged): every document with its worst segment's score.

    score is the largest log-likelihood ratio of harmful against ordinary over the
    document's sentences and lines, in nats a word; flagged is a score above
    ``threshold``. A text that is null, empty or without words scores 0. Repeated ids
    stay rows; no documents give no rows; without labels of both kinds all score 0.

    1. The words of all texts, disguises read through the lexicon of the judged snippets.
    2. First model: at most ``max_labels`` judged snippets (in hash order), and as
       ordinary the documents' trigrams of a share of at least ``usual``. Rarer ones may
       be abuse, so at first they are of neither class.
    3. Segments it scores above ``seed`` are harmful; trigrams seen beside such segments
       far more often than chance puts them there are harmful as well (abuse comes in
       company); those that clearly keep to their share, or are usual, are ordinary. This
       counts all documents and every trigram, however rare.
    4. Second model from these and the snippets; it scores all documents.

    Both models are tables over all trigrams of documents and snippets (``log_ratios``),
    joined to the documents'. Trigrams without a class count for the shared backoff. To
    the driver come the snippets, the usual trigrams (there can't be more than
    1 / ``usual``) and the numbers for the words of both.
    """
    spark = documents.sparkSession
    judged = labels.where("snippet is not null and is_harmful is not null").select("snippet", "is_harmful").orderBy(F.xxhash64("snippet"), "snippet", "is_harmful").limit(max_labels).collect()
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    if len({r["is_harmful"] for r in judged}) < 2:
        return docs.select("doc_id", "source", F.lit(0.0).alias("score"), F.lit(False).alias("flagged"))
    first = Words(())
    lexicon = sorted({w for r in judged for s in first.segments(r["snippet"]) for w in s if w[0] != "<" and w != '"'})
    reader = Words(lexicon)
    snippets = [(list(reader.segments(r["snippet"])), bool(r["is_harmful"])) for r in judged]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(lexicon)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "segments": [[" ".join(s) for s in words.segments(t)] if isinstance(t, str) else [] for t in b["text"]]})

    texts = cut(docs.mapInPandas(read, "doc_id bigint, source string, segments array<string>").withColumn("at", F.monotonically_increasing_id()))
    parts = texts.select("at", F.posexplode("segments").alias("k", "words"))
    counts = cut(_occurrences(parts).groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    scale = min(1.0, 20_000 / max(1, total))  # the documents' counts weigh as much as 20,000 words, whatever their number
    corpus = {r["gram"]: r["n"] * scale for r in counts.where(F.col("n") >= usual * total).collect()}

    def with_snippets(table: DataFrame, harmful: dict[str, float], ordinary: dict[str, float]) -> DataFrame:
        """(gram, h, o): the table's counts and the snippets'."""
        own = spark.createDataFrame([(g, float(harmful.get(g, 0)), float(ordinary.get(g, 0))) for g in {*harmful, *ordinary, *unlabelled}], "gram string, h double, o double")
        return cut(table.select("gram", F.col("h").cast("double").alias("h"), F.col("o").cast("double").alias("o")).unionByName(own).groupBy("gram").agg(F.sum("h").alias("h"), F.sum("o").alias("o")))

    def segment_scores(model: DataFrame) -> DataFrame:
        """(at, k, score) of every segment."""
        m = _occurrences(parts, "at", "k").join(small(cut(model)), "gram").groupBy("at", "k").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
        return m.select("at", "k", (F.col("x") / (F.col("n") + 2.0)).alias("score"))  # as of Scorer

    unlabelled = set(_count(s for segments, _ in snippets for s in segments))
    pair = F.split("gram", " ")
    follow = cut(counts.select("gram").unionByName(spark.createDataFrame([(g,) for g in unlabelled], "gram string")).select(pair[1].alias("b"), pair[2].alias("w")).distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    asked = spark.createDataFrame([(w,) for w in {g.split(" ")[2] for g in unlabelled | set(corpus)}], "w string")
    sums = follow.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("words")).first()
    harmful, ordinary = fit_labels(snippets, corpus, ({r["w"]: r["n"] for r in follow.join(asked, "w", "left_semi").collect()}, sums["total"], sums["words"]))

    model = log_ratios(with_snippets(counts.select("gram", F.lit(0.0).alias("h"), F.when(F.col("n") >= usual * total, F.col("n") * scale).otherwise(0.0).alias("o")), harmful, ordinary))
    strong = segment_scores(model).where(F.col("score") > seed).groupBy("at").agg(F.collect_list("k").alias("strong"))
    kind = F.when(F.col("strong").isNull(), 2).when(F.array_contains("strong", F.col("k")), 0).otherwise(1)
    near = texts.join(strong, "at", "left").select("strong", F.posexplode("segments").alias("k", "words")).select(kind.alias("kind"), "words")
    seen = cut(_occurrences(near, "kind").groupBy("gram").agg(*(F.sum((F.col("kind") == i).cast("bigint")).alias(f"n{i}") for i in range(3))))
    sums = seen.agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2")).first()
    rate = min(0.5, max(1e-6, (sums["n1"] or 0) / max(1, (sums["n1"] or 0) + (sums["n2"] or 0))))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keeps: dict[tuple[int, int], tuple[bool, bool]] = {}
        for b in batches:
            h, o = [], []
            for n0, n1, n2 in zip(b["n0"].tolist(), b["n1"].tolist(), b["n2"].tolist(), strict=True):
                n = n1 + n2
                if (got := keeps.get((n1, n))) is None:
                    if len(keeps) > 200_000:
                        keeps.clear()
                    bad = n1 >= 2 and n1 >= max(0.12, 2 * rate) * n and _binomial_tails(n1, n, rate) < 1e-3
                    got = keeps[n1, n] = bad, n >= usual * total or 1 - _binomial_tails(n1 + 1, n, 0.3) < 0.02
                if n and (n0 > 2 * n or got[0]):
                    h.append(n0 + n)
                    o.append(0.0)
                else:
                    h.append(n0)
                    o.append(n * scale if got[1] else 0.0)
            yield pd.DataFrame({"gram": b["gram"], "h": pd.Series(h, dtype=float), "o": pd.Series(o, dtype=float)})

    learnt = of_weight(cut(seen.mapInPandas(label, "gram string, h double, o double")), "h", 5_000)  # a fixed weight, as the ordinary ones have
    final = log_ratios(with_snippets(learnt, harmful, ordinary))
    worst = segment_scores(final).groupBy("at").agg(F.max("score").alias("score"))
    out = texts.select("at", "doc_id", "source").join(worst, "at", "left").select("doc_id", "source", F.coalesce("score", F.lit(0.0)).alias("score"))
    return out.withColumn("flagged", F.col("score") > threshold)


def source_rates(scored: DataFrame) -> DataFrame:
    """(source, documents, harmful, rate): sources trimmed and in lower case, null where there is none."""
    name = F.lower(F.regexp_replace("source", r"^[\s ]+|[\s ]+$", ""))
    return scored.groupBy(F.when(name != "", name).alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("flagged").cast("bigint")).alias("harmful")).withColumn("rate", F.col("harmful") / F.col("documents"))
