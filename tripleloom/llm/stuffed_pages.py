"""Pages of stuffed keywords, links and product or tag lists.

A page is read as a sequence of function words and word classes (a link, a tag, a price, a word
or a pair of words that just stood there, a name ...).  An n-gram model trained on prose scores the
sequence; the perplexity of a window of units is abnormal where it lies above or below given
quantiles of the perplexity of prose that the model was not trained on.  A page is a case if such
windows make up more than half of its text.  Labelled stuffed pages only choose the quantiles.

All steps work on the whole units of many pages at once, as arrays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.session import cut_lineage, spread

#: Signs of Latin words in addresses, and those written without spaces between words.
LATIN, HAN = "A-Za-z0-9_À-ɏ", "぀-ヿ㐀-䶿一-鿿"
#: The units in the order they are tried; none of them looks at a sign more than a few times.
UNITS = re.compile(
    r"\]\([^()\s]+\)"  # the target of a named link
    r"|</?[a-zA-Z][^<>\n]*>"  # a tag
    r"|(?:https?://|www\.)[^\s<>()\[\]\"|]+"  # a link
    rf"|[{LATIN}-]++(?:\.[{LATIN}-]++)++(?:/[^\s<>()\[\]\"|]*)?"  # something dotted: a host, a relation, a decimal
    r"|#\w+"
    r"|\d++,\d\d(?!\w)"
    r"|[A-Za-z]++\d\w*|\d++[A-Za-z]\w*"
    r"|\d+"
    rf"|[{HAN}]"
    rf"|[^\W\d_{HAN}]+"
    r"|[\r\n]+"
    r"|[^\w\s]|_"
)
RELATION, PRICE = re.compile(r"[a-z_]+\.[a-z_]+\.[a-z_]+"), re.compile(r"\d+[.,]\d\d")
#: Sizes of the model: words that stand for themselves, the reach of repetition, half a window, the weight
#: of a shorter history in pages, which share of the prose is trusted to be prose, the share of a page that makes it a case.
VOCABULARY, NEAR, HALF, WEIGHT, TRUSTED, BORDER = 64, 12, 10, 4.0, 0.98, 0.5
#: Classes after which the history is cut: what they lead to is no sentence, so they predict nothing.
CUT = ("link", "target", "tag", "hash", "pair again")
#: Quantiles of the perplexity of prose above or below which a window may count as abnormal (None: on that side none
#: does), and those taken without labels.
HIGH, LOW, USUAL = (0.99, 0.995, 0.997, 0.998, 0.999, 0.9993, 0.9995, 0.9997, 0.9998, 0.9999, 1.0), (None, 0.0, 0.0001, 0.001), (0.9997, None)
#: Forms of units a worker remembers, and the signs of text it reads at a time; one text is read whole.
REMEMBERED, AT_ONCE = 300_000, 1 << 20
WORD, KNOWN, HAN_UNIT = 1, 2, 3
#: Signs of texts without spaces that are read as their Latin counterparts.
WIDE_SIGNS = dict(zip("，。、；：！？（）", ",.,;:!?()"))
BASE = 1 << 14


def unit_kind(u: str) -> str:
    """The class of a unit, but for repetition and for words that stand for themselves."""
    first = u[0]
    if len(u) > 1:
        if first == "]":
            return "target"
        if first == "<":
            return "tag"
        if first == "#":
            return "hash"
        if "/" in u or u.startswith("www."):
            return "link"
        if PRICE.fullmatch(u):
            return "price"
        if "." in u:
            parts = u.split(".")
            return "relation" if RELATION.fullmatch(u) else "host" if all(any(c.isalpha() for c in p) for p in parts) else "decimal"
    if first in "\r\n":
        return "line" if len(u.replace("\r", "")) < 2 else "lines"
    if u.isdigit():
        return "number"
    if first.isalpha() or first.isdigit():
        if any(c.isdigit() for c in u):
            return "code"
        return "han" if "぀" <= first <= "鿿" else "word"
    return "sign"


def units(text: str) -> list[tuple[str, str]]:
    """``(class, unit)`` of a page, in order."""
    return [(unit_kind(u), u) for u in UNITS.findall(text)]


@dataclass
class Pages:
    """The units of some pages: class numbers, lengths, the page of each, where pages begin; the
    classes of the one and the two units before (0 before a page's begin)."""

    cls: np.ndarray
    length: np.ndarray
    page: np.ndarray
    starts: np.ndarray
    before: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> int:
        return len(self.starts) - 1

    def smoothed(self, x: np.ndarray) -> np.ndarray:
        """The mean over the window around each unit, within its page."""
        sums = np.concatenate([[0.0], np.cumsum(x)])
        at = np.arange(len(x))
        low, high = np.maximum(at - HALF, self.starts[self.page]), np.minimum(at + HALF + 1, self.starts[self.page + 1])
        return np.round((sums[high] - sums[low]) / (high - low), 9)  # the same whatever pages are read along

    def share(self, flagged: np.ndarray) -> np.ndarray:
        """Which share of each page's text the flagged units are; 0 for a page without text."""
        whole = np.bincount(self.page, self.length, self.n)
        return np.bincount(self.page, self.length * flagged, self.n) / np.maximum(whole, 1)


class _Forms(dict):
    """The number of each form of a unit, given when it first comes up."""

    def __init__(self, reader: ClassReader) -> None:
        self.reader = reader
        self.lower: dict[str, int] = {}
        self.rows: list[tuple[int, int, int]] = []

    def __missing__(self, u: str) -> int:
        low = u.lower()
        n = self[u] = len(self.rows)
        self.rows.append((*self.reader.base_class(u, low), self.lower.setdefault(low, len(self.lower))))
        return n


def page_words(text: str) -> set[str]:
    """The words of a page that may stand for themselves."""
    return {u.lower() for u in set(UNITS.findall(text)) if unit_kind(u) in ("word", "han")}


def page_signs(text: str) -> set[str]:
    return {WIDE_SIGNS.get(u, u) for u in set(UNITS.findall(text)) if unit_kind(u) == "sign"}


class ClassReader:
    """Pages as sequences of class numbers.

    The most widespread words of the prose stand for themselves.  Other words that stood among the
    last few, and words that stood there after the same word, are classes of their own, so
    repetition shows whatever the keyword is.  Signs that the sample doesn't hold are one class.
    """

    def __init__(self, prose: Sequence[str]) -> None:
        widespread: Counter = Counter()
        for text in prose:
            widespread.update(page_words(text))
        self._name([w for w, n in sorted(widespread.items(), key=lambda x: (-x[1], x[0])) if n >= 3][:VOCABULARY])

    @classmethod
    def of(cls, known: Sequence[str], signs: Sequence[str]) -> ClassReader:
        """A closed reader of the given words and signs."""
        out = object.__new__(cls)
        out._name(known)
        for sign in signs[: BASE - len(out.number)]:  # a class must fit its place in a key
            out.number["sign " + sign] = len(out.number)
        out.close()
        return out

    def _name(self, known: Sequence[str]) -> None:
        names = ["", "unseen sign", "word", "Name", "CAPS", "again", "pair", "pair again"]
        names += ["target", "tag", "link", "hash", "relation", "host", "decimal", "price", "code", "number", "line", "lines", *("=" + w for w in known)]
        self.number = {name: i for i, name in enumerate(names)}
        self.open, self.forms = True, None

    def close(self) -> None:
        """From now on no class is added."""
        self.open, self.forms = False, None

    def base_class(self, u: str, low: str) -> tuple[int, int]:
        kind = unit_kind(u)
        if kind == "word":
            own = self.number.get("=" + low)
            return (own, KNOWN) if own is not None else (self.number["CAPS" if u.isupper() and len(u) > 1 else "Name" if u[0].isupper() else "word"], WORD)
        if kind == "han":
            return self.number.get("=" + u, self.number["word"]), HAN_UNIT
        if kind == "sign":
            u = WIDE_SIGNS.get(u, u)
            if self.open:
                return self.number.setdefault("sign " + u, len(self.number)), 0
            return self.number.get("sign " + u, self.number["unseen sign"]), 0
        return self.number[kind], 0

    def read(self, texts: Sequence[str | None]) -> Pages:
        """The pages' units; line ends are no part of a text's length."""
        found = [UNITS.findall(t) if t else [] for t in texts]
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        n = int(sizes.sum())
        if self.forms is None or len(self.forms) > REMEMBERED:
            self.forms = _Forms(self)
        number = self.forms.__getitem__
        forms = np.fromiter((number(u) for f in found for u in f), np.int64, n)
        length = np.fromiter((len(u) for f in found for u in f), np.int64, n)
        cls, sort, low = np.array(self.forms.rows, dtype=np.int64).reshape(-1, 3)[forms].T.copy()
        page = np.repeat(np.arange(len(found)), sizes)
        self._mark_repetition(cls, sort, low, page)
        length[(cls == self.number["line"]) | (cls == self.number["lines"])] = 0
        starts = np.concatenate([[0], np.cumsum(sizes)])
        before, first = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = np.arange(n) - starts[page]
        before[1:], first[2:] = cls[:-1], cls[:-2]
        before[place < 1], first[place < 2] = 0, 0
        cut = np.zeros(len(self.number), dtype=bool)
        cut[[self.number[c] for c in CUT]] = True
        first[cut[first] | cut[before]] = -1
        before[cut[before]] = -1
        return Pages(cls, length, page, starts, before, first)

    def _mark_repetition(self, cls: np.ndarray, sort: np.ndarray, low: np.ndarray, page: np.ndarray) -> None:
        w = np.flatnonzero((sort == WORD) | (sort == HAN_UNIT))
        if not len(w):
            return
        han, word, own = sort[w] == HAN_UNIT, low[w], page[w]
        last = np.zeros(len(w), np.int64)
        last[1:] = np.where(own[1:] == own[:-1], word[:-1] + 1, 0)
        _, alone = np.unique((own << 32) | word, return_inverse=True)
        _, pair = np.unique((alone << 32) | last, return_inverse=True)
        reach = np.where(han, 2 * NEAR, NEAR)
        near = _distance(alone, 1) <= reach
        twice, thrice = _distance(pair, 1) <= reach, _distance(pair, 2) <= 2 * reach
        new = cls[w]
        for mark, name in ((near & ~han, "again"), (twice, "pair"), (twice & thrice, "pair again")):
            new[mark] = self.number[name]
        cls[w] = new


def _distance(key: np.ndarray, times: int) -> np.ndarray:
    """How many places ago the same key stood for the ``times``-th time; very far if never."""
    out = np.full(len(key), 1 << 40)
    order = np.argsort(key, kind="stable")
    same = key[order][times:] == key[order][:-times]
    out[order[times:][same]] = (order[times:] - order[:-times])[same]
    return out


class _Counts:
    """In how many pages each key stands, and each page's own keys."""

    def __init__(self, page: np.ndarray, key: np.ndarray) -> None:
        self.own = np.unique((page << 42) | key)  # three classes take 42 bits
        self.keys, self.counts = np.unique(self.own & ((1 << 42) - 1), return_counts=True)

    def of(self, key: np.ndarray) -> np.ndarray:
        return _looked_up(self.keys, self.counts, key)

    def summed(self, shift: int) -> _Counts:
        """The same per history, which is a key without its last class."""
        out = object.__new__(_Counts)
        out.keys, at = np.unique(self.keys >> shift, return_inverse=True)
        out.counts = np.bincount(at, self.counts, len(out.keys))
        out.own, out.own_counts = np.unique(self.own >> shift, return_counts=True)
        return out


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0).astype(np.float64)


class ProseModel:
    """An interpolated trigram model of classes, counted in pages: a page counts once for each n-gram."""

    def __init__(self, classes: int, pages: Pages, kept: np.ndarray) -> None:
        self.classes = classes
        self.tables = []
        for key, held in self._keys(pages):
            use = kept & held
            counts = _Counts(pages.page[use], key[use])
            self.tables.append((counts, counts.summed(14)))

    @classmethod
    def of(cls, classes: int, tables: Sequence[tuple[np.ndarray, np.ndarray]]) -> ProseModel:
        """The model of counts that were gathered elsewhere: keys and pages of each order."""
        out = object.__new__(cls)
        out.classes, out.tables = classes, []
        for keys, counts in tables:
            whole = object.__new__(_Counts)
            order = np.argsort(keys)
            whole.keys, whole.counts = keys[order], counts[order]
            whole.own = np.zeros(0, np.int64)
            out.tables.append((whole, whole.summed(14)))
        return out

    def besides(self, pages: Pages, kept: np.ndarray) -> ProseModel:
        """This model, which counted the kept units of ``pages`` among others, ready to leave each of them out."""
        out, local = object.__new__(ProseModel), ProseModel(self.classes, pages, kept)
        out.classes, out.tables = self.classes, []
        for ours, theirs in zip(self.tables, local.tables):
            both = []
            for whole, own in zip(ours, theirs):
                joint = object.__new__(_Counts)
                joint.keys, joint.counts, joint.own, joint.own_counts = whole.keys, whole.counts, own.own, getattr(own, "own_counts", None)
                both.append(joint)
            out.tables.append(tuple(both))
        return out

    @staticmethod
    def _keys(p: Pages) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order the n-gram of every unit, and where its history isn't cut."""
        before, first = np.maximum(p.before, 0), np.maximum(p.first, 0)
        yield p.cls, np.ones(len(p.cls), dtype=bool)
        yield before * BASE + p.cls, p.before >= 0
        yield (first * BASE + before) * BASE + p.cls, p.first >= 0

    def surprise(self, pages: Pages, left_out: np.ndarray | None = None) -> np.ndarray:
        """The negative log probability of each unit.  ``left_out`` marks units whose page was counted
        and is now scored as if it hadn't been."""
        p = np.full(len(pages.cls), 1.0 / self.classes)
        for (counts, histories), (key, held) in zip(self.tables, self._keys(pages)):
            n, whole = counts.of(key), histories.of(key >> 14)
            if left_out is not None:
                own = (pages.page << 42) | key
                n -= left_out * _looked_up(counts.own, np.ones(len(counts.own)), own)
                whole -= left_out * _looked_up(histories.own, histories.own_counts, own >> 14)
            better = (n + WEIGHT * p) / (whole + WEIGHT)
            p = np.where(held, better, p)
        return -np.log(p)

    def forget_pages(self) -> None:
        """Drops what only leaving a page out needs."""
        for table in self.tables:
            for counts in table:
                counts.own = counts.own_counts = None


class StuffedModel:
    """What share of a page is stuffed: ``shares(texts)``."""

    def __init__(self, labelled: Sequence[tuple[str | None, int]]) -> None:
        labelled = [(t or "", int(bool(y))) for t, y in labelled]
        prose = [t for t, y in labelled if not y]
        self.model: ProseModel | None = None
        if not any(t.strip() for t in prose):
            return
        self.reader = ClassReader(prose)
        pages = self.reader.read([t for t, _ in labelled])
        stuffed = np.array([y for _, y in labelled], dtype=bool)
        self.reader.close()
        own = ~stuffed[pages.page]  # units of prose pages
        kept = own
        for trusted in (TRUSTED, None):  # prose pages may hold some stuffing, which is left out the second time
            model = ProseModel(len(self.reader.number), pages, kept)
            window = pages.smoothed(model.surprise(pages, own.astype(np.float64)))
            if trusted:
                kept = own & (window <= np.quantile(window[own], trusted))
        self.low, self.high = self._bounds(pages, window, np.sort(window[kept]), stuffed)
        model.forget_pages()
        self.model = model
        self.reader.forms = None

    @staticmethod
    def usual(choice: tuple) -> tuple[int, int]:
        """How far a choice of quantiles lies from the usual ones."""
        high, low = choice
        return LOW.index(low), abs(HIGH.index(high) - HIGH.index(USUAL[0]))

    @staticmethod
    def _bounds(pages: Pages, window: np.ndarray, prose: np.ndarray, stuffed: np.ndarray) -> tuple[float, float]:
        """The quantiles of prose that err least on the labelled pages; the usual ones where nothing is better."""
        at = lambda q: -np.inf if q is None else float(np.quantile(prose, q))

        def cost(choice: tuple) -> tuple:
            high, low = choice
            case = pages.share((window > at(high)) | (window < at(low))) > BORDER
            return int((case != stuffed).sum()), *StuffedModel.usual(choice)

        high, low = min(((h, l) for h in HIGH for l in LOW), key=cost) if stuffed.any() else USUAL
        return at(low), at(high)

    def scores(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The share of each text that is stuffed, and its perplexity; 0 and null (nan) for a text without units."""
        if self.model is None:
            return np.zeros(len(texts)), np.full(len(texts), np.nan)
        pages = self.reader.read(texts)
        surprise = self.model.surprise(pages)
        window = pages.smoothed(surprise)
        size = np.diff(pages.starts)
        perplexity = np.exp(np.bincount(pages.page, surprise, pages.n) / np.maximum(size, 1))
        return pages.share((window > self.high) | (window < self.low)), np.where(size > 0, perplexity, np.nan)

    def share(self, text: str | None) -> float:
        return float(self.scores([text])[0][0])


def _chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """From where to where texts are read at a time."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= AT_ONCE or i + 1 == len(texts):
            yield start, i + 1
            start, size = i + 1, 0


def _gathered(pages: DataFrame, step: Callable[[list[str], np.ndarray], Iterator[tuple]], schema: str) -> DataFrame:
    """What ``step`` makes of the texts and labels of a few pages at a time, as rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, labels = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), dtype=bool)
            for low, high in _chunks(texts):
                for columns in step([t or "" for t in texts[low:high]], labels[low:high]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return pages.mapInArrow(run, schema)


def exact_quantiles(values: DataFrame, shares: Sequence[float]) -> list[float]:
    """The quantiles of ``(v, n)``, values from 0 on with how often they stand there; none without values.

    Values are counted in steps of a thousandth; only where a wanted one lies are they put in order."""
    values = values.withColumn("b", F.floor(F.col("v") * 1000))
    counts = sorted((r["b"], r["n"]) for r in values.groupBy("b").agg(F.sum("n").alias("n")).collect())  # one row a step of a logarithm
    whole = sum(n for _, n in counts)
    if not whole:
        return []
    spots = [q * (whole - 1) for q in shares]
    ranks = sorted({int(x) for x in spots} | {min(int(x) + 1, whole - 1) for x in spots})
    wanted, before, i = [], 0, 0
    for b, n in counts:
        while i < len(ranks) and ranks[i] < before + n:
            wanted.append((b, ranks[i] - before, ranks[i]))
            i += 1
        before += n
    asked = values.sparkSession.createDataFrame(wanted, "b long, at long, rank long")
    order = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = values.join(F.broadcast(asked.select("b").distinct()), "b").groupBy("b", "v").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(order))
    found = inside.join(F.broadcast(asked), "b").where("at < upto AND at >= upto - n").select("rank", "v")  # two a share
    at = {r["rank"]: r["v"] for r in found.collect()}
    return [at[int(x)] + (at[min(int(x) + 1, whole - 1)] - at[int(x)]) * (x - int(x)) for x in spots]


def fitted(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> StuffedModel:
    """The StuffedModel of all labelled texts, read by the executors.

    Only counts come to the driver: the most widespread words, signs, n-grams of classes (as many as classes allow,
    however many texts), the errors of each choice of quantiles."""
    chosen = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("__key"), (F.col(label) == 1).alias("y")).distinct()
    pages = documents.select(F.col(key).alias("__key"), F.col(text).alias("t")).join(chosen, "__key").select("t", "y")
    pages = spread(cut_lineage(pages))  # read six times below
    share = pages.sparkSession.sparkContext.broadcast
    model = StuffedModel([])

    def names(texts: list[str], y: np.ndarray) -> Iterator[tuple]:
        found: Counter = Counter()
        for t, stuffed in zip(texts, y):
            found.update(("sign", u) for u in page_signs(t))
            if not stuffed:
                found.update(("word", u) for u in page_words(t))
        yield [k for k, _ in found], [u for _, u in found], [int(n) for n in found.values()]

    units_ = cut_lineage(_gathered(pages, names, "kind string, u string, n long").groupBy("kind", "u").agg(F.sum("n").alias("n")))
    most = lambda kind, least, size: [r["u"] for r in units_.where((F.col("kind") == kind) & (F.col("n") >= least)).orderBy(F.desc("n"), "u").limit(size).collect()]  # noqa: E731  # the model's classes
    reader = ClassReader.of(most("word", 3, VOCABULARY), most("sign", 1, BASE))
    classes = len(reader.number)

    def counted(kept: Callable[[Pages, np.ndarray], np.ndarray]) -> ProseModel | None:
        def step(texts: list[str], y: np.ndarray) -> Iterator[tuple]:
            read = reader.read([t for t, stuffed in zip(texts, y) if not stuffed])
            local = ProseModel(classes, read, kept(read, np.ones(len(read.cls), dtype=bool)))
            for i, (counts, _) in enumerate(local.tables):
                yield np.full(len(counts.keys), i, np.int64), counts.keys.astype(np.int64), counts.counts.astype(np.int64)

        rows = _gathered(pages, step, "i long, k long, n long").groupBy("i", "k").agg(F.sum("n").alias("n")).toArrow()
        i, k, n = (rows.column(c).to_numpy() for c in ("i", "k", "n"))
        return ProseModel.of(classes, [(k[i == order], n[i == order]) for order in range(3)]) if len(k) else None

    def windows(m: ProseModel, p: Pages, kept: np.ndarray, own: np.ndarray) -> np.ndarray:
        return p.smoothed(m.besides(p, kept).surprise(p, own.astype(np.float64)))

    every = counted(lambda p, own: own)
    if every is None:
        return model
    first = share(every)

    def trusted(border: float) -> Callable[[Pages, np.ndarray], np.ndarray]:
        return lambda p, own: own & (windows(first.value, p, own, own) <= border)

    def values(window: Callable[[Pages, np.ndarray], np.ndarray]) -> DataFrame:
        def step(texts: list[str], y: np.ndarray) -> Iterator[tuple]:
            read = reader.read([t for t, stuffed in zip(texts, y) if not stuffed])
            v, n = np.unique(window(read, np.ones(len(read.cls), dtype=bool)), return_counts=True)
            yield v, n.astype(np.int64)

        return cut_lineage(_gathered(pages, step, "v double, n long"))

    kept = trusted(exact_quantiles(values(lambda p, own: windows(first.value, p, own, own)), [TRUSTED])[0])
    prose = counted(kept)
    second = share(prose)
    quantiles = [q for q in (*HIGH, *LOW) if q is not None]

    def kept_windows(p: Pages, own: np.ndarray) -> np.ndarray:
        k = kept(p, own)
        return windows(second.value, p, k, own)[k]

    at = dict(zip(quantiles, exact_quantiles(values(kept_windows), quantiles))) | {None: -np.inf}
    options = [(h, l) for h in HIGH for l in LOW]

    def errors(texts: list[str], y: np.ndarray) -> Iterator[tuple]:
        read = reader.read(texts)
        own = ~y[read.page]
        window = windows(second.value, read, kept(read, own), own)
        wrong = [int(((read.share((window > at[h]) | (window < at[l])) > BORDER) != y).sum()) for h, l in options]
        yield list(range(len(options))), wrong, [int(y.sum())] * len(options)

    costs = _gathered(pages, errors, "i long, wrong long, stuffed long").groupBy("i").agg(F.sum("wrong").alias("wrong"), F.sum("stuffed").alias("stuffed")).collect()
    wrong = {options[r["i"]]: r["wrong"] for r in costs}
    high, low = min(options, key=lambda c: (wrong[c], *StuffedModel.usual(c))) if costs[0]["stuffed"] else USUAL
    model.reader, model.model, model.low, model.high = reader, prose, at[low], at[high]
    model.model.forget_pages()
    model.reader.forms = None
    return model


def stuffed_shares(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "is_stuffed") -> DataFrame:
    """``(<key>, share, perplexity)``: what share of each text is stuffed, and the perplexity of the whole.

    The model is fitted on every labelled text, and every text is scored, whole.  Null, empty and blank texts have share 0 and no
    perplexity.  Without labelled prose nothing is a case; with no stuffed label the usual
    quantiles hold.  Rows come out each, repeated or not; other columns are ignored.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(fitted(documents, labels, key, text, label))  # counts of n-grams of classes
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = shared.value.scores
        for b in batches:
            texts = b.column(1).to_pylist()
            for low, high in _chunks(texts):
                share, perplexity = scores(texts[low:high])
                known = pa.array(perplexity, pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), pa.array(share, pa.float64()), known], names=["key", "share", "perplexity"])

    return (
        spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))
        .mapInArrow(run, f"key {kind}, share double, perplexity double")
        .withColumnRenamed("key", key)
    )


def stuffed_pages(documents: DataFrame, labels: DataFrame, **parameters: object) -> DataFrame:
    """The documents' keys of which more than half of the text is stuffed; see stuffed_shares."""
    scored = stuffed_shares(documents, labels, **parameters)
    return scored.where(F.col("share") > BORDER).select(scored.columns[0])
