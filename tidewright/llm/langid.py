"""Languages of documents and of their text cells, by Kneser-Ney character models.

Method: one interpolated Kneser-Ney model of characters per language, of order ``order``, over words with a blank on either
side.  N-grams are 64-bit hashes in sorted arrays shared by the languages, with one column of discounted probabilities and of back-off
weights per language; a cell takes the language of the lowest cross-entropy per character.  As a cell's score is the sum of its words' scores,
each distinct word is scored once per worker.  What a cell's length is worth as evidence, the temperature and the limit of rejection are
calibrated on cells held out before any model is fitted.

Training takes a bounded sample of labelled documents (``LangParams.docs_per_language``, whole documents), the first by a
hash of doc_id; labels may be wrong, so cells that a model of the other half of the sample gives to another language are left out.
Everything else covers all documents, whole cells and all words.  The label of a document takes no part in its language.

Defined results
* Only cells of type ``text`` count; a document without one gives no row.  Null texts have none.
* Code, formulas, links, markup, digits and short quoted phrases are no evidence, unless nothing else is there.
* A cell whose cross-entropy is unlike that of any language is rejected: its language is null, its reason ``unlike``.
* A cell in which several languages are about equally likely (reason ``undecided``) takes the document's language if that is among them, else the most likely.
* A cell without words (reason ``no evidence``) takes the document's language.
* The main language is the one with most characters over the decided text cells; of equals the one first in the list of languages.  Without a decided
  cell it is the most likely one over the undecided cells together, and without those null.
* ``plausible`` are the languages that a document's evidence leaves open: the main one, or those that are about equally likely where no cell is decided.
* A cell's body ends where the text ends, however long it is said to be; null positions give an empty body.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.llm.encode import file_bytes

# ISO 639-2 codes (both variants) of languages by their ISO 639-1 code.
ISO_639_2 = {
    "cs": ["ces", "cze"], "da": ["dan"], "de": ["deu", "ger"], "el": ["ell", "gre"], "en": ["eng"], "es": ["spa"], "fi": ["fin"], "fr": ["fra", "fre"],
    "hu": ["hun"], "it": ["ita"], "ja": ["jpn"], "ko": ["kor"], "nb": ["nob"], "nl": ["nld", "dut"], "pl": ["pol"], "pt": ["por"], "ro": ["ron", "rum"],
    "ru": ["rus"], "sv": ["swe"], "tr": ["tur"], "uk": ["ukr"], "zh": ["zho", "chi"],
}


SMALL = 4 << 20
LEAST_HELD = 8  #: held-out cells of a language below which the spread of all languages stands for its own


@dataclass(frozen=True)
class LangParams:
    order: int = 5  #: longest n-gram
    docs_per_language: int = 200  #: labelled documents in the training sample, whole
    held_out: int = 5  #: every so many-th cell of the sample calibrates
    false_reject: float = 0.001  #: share of held-out cells that lie farther from the usual cross-entropy than the limit of rejection before its margin
    margin: float = 2.0  #: factor of that limit: cells that quote another language lie farther out than pure ones
    undecided: float = 2.5  #: nats of a whole cell within which languages count as equally likely
    seed: int = 7


def label_language(label: Column, languages: list[tuple[str, str]]) -> Column:
    """The code that a label names, in any spelling: code, ISO 639-2 code, name, with a region or remark behind it; else null.

    languages: (code, name).
    """
    bare = F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    head = F.regexp_extract(bare, r"^(\p{L}+)(?:[\s\p{Z}_\-(.@].*)?$", 1)
    out = F.lit(None).cast("string")
    for code, name in languages:
        names = {code.lower(), *ISO_639_2.get(code.lower(), []), *([name.lower()] if name else [])}
        out = F.when(head.isin(*sorted(names)), F.lit(code)).otherwise(out)
    return out


_NOISE = re.compile(r"```.*?```|`[^`]*`|\$\$.*?\$\$|\$[^$\n]*\$|\]\([^)]*\)|https?://\S+|<[^<>]*>|&[a-zA-Z]+;", re.S)
_QUOTED = re.compile(r"[“„«\"][^“”„«»\"\n]{1,60}[”“»\"]")
_WORD = re.compile(r"[^\W\d_]+")


def _mended(word: str) -> str:
    """UTF-8 that was read as Latin-1 put right."""
    try:
        return word.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return word


def evidence(body: str) -> list[str]:
    """The words of a cell that tell its language, in lower case."""
    if not body.isascii():
        if "Ã" in body or "Ð" in body or "Å" in body or "Ñ" in body or "Â" in body or "ã" in body:
            body = " ".join(map(_mended, body.split(" ")))
        body = unicodedata.normalize("NFC", body)
    text = _NOISE.sub(" ", body)
    return _WORD.findall(_QUOTED.sub(" ", text).lower()) or _WORD.findall(text.lower())


def plain(word: str) -> str:
    """A word without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)


def _grams(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each length n up to ``order`` the hash of the n-gram ending at each position, the position in its word, and the word's number."""
    text = "".join(f" {w} " for w in words)
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    word = np.repeat(np.arange(len(words)), size)
    pos = np.arange(len(cp)) - np.repeat(np.cumsum(size) - size, size)
    out = []
    with np.errstate(over="ignore"):
        one = (cp + np.uint64(1)) * _MIX
        h = one ^ (one >> np.uint64(29))
        out.append(h * _MUL)
        for n in range(2, order + 1):
            # the n-gram ending at i is the (n-1)-gram ending at i-1 and the character at i
            prev = np.empty_like(cp)
            prev[1:] = out[-1][:-1]
            prev[0] = 0
            x = (prev ^ (prev >> np.uint64(32))) * _MUL + one
            out.append((x ^ (x >> np.uint64(29))) * _MIX)
    return out, pos, word


class Model:
    """Interpolated Kneser-Ney models of several languages in shared sorted hash arrays."""

    def __init__(self, counts: list[Counter], order: int):
        self.order, self.n_languages = order, len(counts)
        letters: set[str] = set()
        for c in counts:
            for w in c:
                letters.update(w)
        self.floor = 1.0 / (len(letters) + 50)
        per = [self._one(c, order) if c else None for c in counts]
        self.gram: list[tuple[np.ndarray, np.ndarray]] = []
        self.context: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(order):
            for store, which, default in ((self.gram, 0, 0.0), (self.context, 1, 1.0)):
                keys = np.unique(np.concatenate([p[which][n][0] for p in per if p] or [np.zeros(0, np.uint64)]))
                values = np.full((len(keys), self.n_languages), default, dtype=np.float32)
                for j, p in enumerate(per):
                    if p:
                        values[np.searchsorted(keys, p[which][n][0]), j] = p[which][n][1]
                store.append((keys, values))

    @staticmethod
    def _one(counts: Counter, order: int):
        words = list(counts)
        hashes, pos, word = _grams(words, order)
        weight = np.array([counts[w] for w in words], dtype=np.float64)[word]
        start = np.uint64(0)
        grams, contexts = [], []
        for n in range(1, order + 1):
            # counts: tokens at the highest order and for n-grams at a word's beginning, else the number of different characters before
            there = (pos >= max(n - 1, 1)) if n > 1 else (pos >= 1)
            at = np.flatnonzero(there)
            h = hashes[n - 1][at]
            prefix = hashes[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
            if n == order:
                key, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                c = np.bincount(inverse, weights=weight[at])
            else:
                opening = pos[at] == n - 1
                longer = hashes[n][at].copy()
                longer[opening] = start
                key, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                pairs = np.unique(np.stack([inverse[~opening].astype(np.uint64), longer[~opening]], axis=1), axis=0)
                c = np.bincount(pairs[:, 0].astype(np.int64), minlength=len(key)).astype(np.float64)
                c += np.bincount(inverse[opening], weights=weight[at][opening], minlength=len(key))
            before = prefix[first]
            n1, n2 = np.count_nonzero(c == 1), np.count_nonzero(c == 2)
            d = n1 / (n1 + 2 * n2) if n1 else 0.5
            d = min(max(d, 0.1), 0.9)
            ctx, which = np.unique(before, return_inverse=True)
            total = np.bincount(which, weights=c)
            kinds = np.bincount(which)
            grams.append((key, (np.maximum(c - d, 0) / total[which]).astype(np.float32)))
            contexts.append((ctx, (d * kinds / total).astype(np.float32)))
        return grams, contexts

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities (words x languages) and the numbers of characters predicted."""
        hashes, pos, _ = _grams(words, self.order)
        p = np.full((len(pos), self.n_languages), self.floor, dtype=np.float32)
        for n in range(1, self.order + 1):
            at = np.flatnonzero(pos >= max(n - 1, 1))
            prefix = hashes[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
            keys, back = self.context[n - 1]
            if not len(keys):
                continue
            i = np.minimum(np.searchsorted(keys, prefix), len(keys) - 1)
            hit = keys[i] == prefix
            at, i = at[hit], i[hit]
            q = p[at] * back[i]
            keys, disc = self.gram[n - 1]
            h = hashes[n - 1][at]
            j = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            seen = keys[j] == h
            q[seen] += disc[j[seen]]
            p[at] = q
        logs = np.where((pos >= 1)[:, None], np.log(p), 0.0)
        begin = np.flatnonzero(pos == 0)
        out = np.add.reduceat(logs, begin, axis=0) if len(begin) else np.zeros((0, self.n_languages))
        return out, np.array([len(w) + 1 for w in words], dtype=np.int64)


class Scorer:
    """Scores cells by cached words."""

    MOST = 400_000  #: words kept; beyond that the cache begins anew, which changes no result

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, model.n_languages))
        self.sizes = np.zeros(0, np.int64)

    def cells(self, cells: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Total log-probabilities (cells x languages) and characters."""
        if len(self.known) > self.MOST:
            self.__init__(self.model)
        known = self.known
        fresh: list[str] = []
        for words in cells:
            for w in words:
                if w not in known:
                    known[w] = len(known)
                    fresh.append(w)
        for a in range(0, len(fresh), 50_000):
            logs, sizes = self.model.score(fresh[a : a + 50_000])
            self.logs, self.sizes = np.concatenate([self.logs, logs]), np.concatenate([self.sizes, sizes])
        lengths = np.array([len(w) for w in cells], dtype=np.int64)
        total, size = np.zeros((len(cells), self.model.n_languages)), np.zeros(len(cells), np.int64)
        full = np.flatnonzero(lengths)
        if len(full):
            flat = np.fromiter((known[w] for words in cells for w in words), dtype=np.int64, count=int(lengths.sum()))
            begin = (np.cumsum(lengths) - lengths)[full]
            total[full] = np.add.reduceat(self.logs[flat], begin, axis=0)
            size[full] = np.add.reduceat(self.sizes[flat], begin)
        return total, size


@dataclass
class Identifier:
    """A calibrated set of models."""

    languages: list[str]
    scorer: Scorer | None
    temperature: float = 1.0
    power: float = 1.0  #: a cell of n characters counts as n ** power independent ones
    usual: np.ndarray | None = None  #: per language the median cross-entropy of its cells, and a and b of its variance a + b / n
    most: float = np.inf  #: distance from the median, in standard deviations, beyond which a cell is rejected

    def posterior(self, total: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Probabilities of the languages from length-normalised cross-entropies."""
        n = np.maximum(size, 1).astype(np.float64)
        scaled = total * (n ** (self.power - 1) / self.temperature)[:, None]
        scaled -= scaled.max(axis=1, keepdims=True)
        e = np.exp(scaled)
        return e / e.sum(axis=1, keepdims=True)

    def distance(self, total: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How much higher the lowest cross-entropy is than usual for a cell of its language and length, in standard deviations."""
        if self.usual is None:
            return np.zeros(len(total))
        n = np.maximum(size, 1)
        middle, a, b = self.usual[total.argmax(axis=1)].T
        return (-total.max(axis=1) / n - middle) / np.sqrt(a + b / n)


Cell = tuple[int, list[str], int]


def train(cells: list[Cell] | list[tuple[int, list[str]]], languages: list[str], params: LangParams = LangParams()) -> Identifier:
    """Identifier from labelled cells (language number, words and number of the document; without it each cell is a document)."""

    def fit(chosen: list[Cell]) -> Model:
        counts = [Counter() for _ in languages]
        for lang, words, _ in chosen:
            counts[lang].update(words)
        for c in counts:
            for w, k in list(c.items()):
                if not w.isascii() and (bare := plain(w)) != w:
                    c[bare] += max(1, k // 2)
        return Model(counts, params.order)

    def agreeing(model: Model, chosen: list[Cell]) -> list[Cell]:
        if not chosen:
            return chosen
        total, _ = Scorer(model).cells([x[1] for x in chosen])
        own = total[np.arange(len(chosen)), [x[0] for x in chosen]]
        return [x for x, best, mine in zip(chosen, total.max(axis=1), own) if best - mine < params.undecided]

    used: list[Cell] = [(x[0], x[1], x[2] if len(x) > 2 else i) for i, x in enumerate(cells) if x[1]]
    if not used:
        return Identifier(languages, None)
    # documents are held out before any model has seen them; their labels may be wrong as well, which the loss allows for
    turn = {d: i for i, d in enumerate(dict.fromkeys(x[2] for x in used))}
    held, rest = [x for x in used if turn[x[2]] % params.held_out == 0], [x for x in used if turn[x[2]] % params.held_out]
    rest = rest or used
    # each half is judged by a model of the other, so that no wrong label speaks for itself
    halves = [[x for x in rest if turn[x[2]] // params.held_out % 2 == k] for k in (0, 1)]
    kept = [x for k in (0, 1) for x in (agreeing(fit(halves[1 - k]), halves[k]) if halves[1 - k] else halves[k])] or rest
    model = fit(kept)
    total, size = Scorer(model).cells([x[1] for x in held])
    truth = np.array([x[0] for x in held])
    wrong = float(np.mean(total.max(axis=1) - total[np.arange(len(held)), truth] >= params.undecided))
    noise = min(0.5, wrong + 0.005)
    best = np.inf
    out = Identifier(languages, None)
    for power in (0.5, 0.6, 0.7, 0.8, 0.9, 1.0):
        for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0):
            p = Identifier(languages, None, t, power).posterior(total, size)[np.arange(len(held)), truth]
            loss = -np.mean(np.log((1 - noise) * p + noise / len(languages)))
            if loss < best - 1e-9:
                best, out.temperature, out.power = loss, t, power
    # rejection looks at the lowest cross-entropy alone, whatever the label says
    each, n = -total.max(axis=1) / np.maximum(size, 1), np.maximum(size, 1).astype(np.float64)

    def spread(each: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
        middle = float(np.median(each))
        square = (each - middle) ** 2
        x = np.stack([np.ones_like(n), 1 / n], axis=1)
        a, b = np.linalg.lstsq(x, square, rcond=None)[0]
        if a <= 0 or b <= 0:  # one of the two explains the spread alone
            a, b = (0.0, float(square @ x[:, 1] / (x[:, 1] @ x[:, 1]))) if a <= 0 else (float(square.mean()), 0.0)
        return middle, max(float(a), 0.01), max(float(b), 0.0)

    own = total.argmax(axis=1)
    pooled = spread(each, n)
    out.usual = np.array([spread(each[own == g], n[own == g]) if np.count_nonzero(own == g) >= LEAST_HELD else pooled for g in range(len(languages))])
    out.most = params.margin * max(float(np.quantile(out.distance(total, size), 1 - params.false_reject)), 3.5)
    out.scorer = Scorer(fit(kept + agreeing(model, held)))
    return out


def _bodies(text: str | None, cells: list[dict] | None) -> list[tuple[int, str, int]]:
    """cell_no, body and characters of the text cells."""
    if not text or not cells:
        return []
    out = []
    for c in cells:
        if c and c["cell_type"] == "text":
            start, n = c["start_pos"], c["body_chars"]
            body = text[start : start + n] if start is not None and n is not None and start >= 0 and n > 0 else ""
            out.append((c["cell_no"], body, len(body)))
    return out


def sample(docs: DataFrame, languages: list[tuple[str, str]], params: LangParams) -> list[Cell]:
    """Labelled cells for training, of at most docs_per_language documents a language."""
    codes = [c for c, _ in languages]
    labelled = docs.select("doc_id", label_language(F.col("lang"), languages).alias("_label")).filter(F.col("_label").isNotNull())
    rank = F.row_number().over(W.partitionBy("_label").orderBy(F.xxhash64("doc_id", F.lit(params.seed)), "doc_id"))
    chosen = labelled.withColumn("_rank", rank).filter(F.col("_rank") <= params.docs_per_language).select("doc_id", "_label")
    # at most docs_per_language rows a language, so that broadcasting them is bounded whatever the corpus
    rows = docs.select("doc_id", "text", "cells").join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, doc, body = [], [], []
            for d, lang, text, cells in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_label", "text", "cells"))):
                for _, b, _ in _bodies(text, cells):
                    if b:
                        label.append(lang), doc.append(d), body.append(b)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "label": pa.array(label, pa.string()), "body": pa.array(body, pa.string())})

    got = rows.mapInArrow(run, "doc_id bigint, label string, body string").toArrow().to_pylist()
    got.sort(key=lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["body"]))
    return [(codes.index(x["label"]), evidence(x["body"]), x["doc_id"]) for x in got]


NO_EVIDENCE, UNLIKE, UNDECIDED = "no evidence", "unlike", "undecided"


def judge(who: Identifier, bodies: list[list[tuple[int, str, int]]], undecided: float) -> list[tuple[int | None, float, list[int], list[tuple]]]:
    """For each document its language number or None, confidence, plausible languages and cells (cell_no, language number or None, confidence, characters, reason)."""
    flat = [evidence(b) for doc in bodies for _, b, _ in doc]
    k_all = len(who.languages)
    if who.scorer is None or not flat:
        total, size = np.zeros((len(flat), k_all)), np.zeros(len(flat), np.int64)
    else:
        total, size = who.scorer.cells(flat)
    post = who.posterior(total, size) if len(flat) else total
    empty = size == 0
    unlike = ~empty & (who.distance(total, size) > who.most) if len(flat) else empty
    top, lead = (total.argmax(axis=1), total.max(axis=1)) if len(flat) else (size, size.astype(float))
    likely = total >= lead[:, None] - undecided
    open_ = ~empty & ~unlike
    sure = open_ & (likely.sum(axis=1) == 1)
    out, at = [], 0
    for doc in bodies:
        rows = slice(at, at + len(doc))
        at += len(doc)
        chars = np.array([c for _, _, c in doc], dtype=np.float64)
        s, o, tops = sure[rows], open_[rows], top[rows]
        weights = np.bincount(tops[s], weights=chars[s], minlength=k_all)
        if s.any():
            lean: int | None = int(weights.argmax())
        elif o.any():
            together = total[rows][o].sum(axis=0)
            lean = int(together.argmax())
        else:
            lean = None
        cells: list[tuple] = []
        for i, (no, _, n) in enumerate(doc):
            row = rows.start + i
            if unlike[row]:
                cells.append((no, None, float(post[row].max()), n, UNLIKE))
            elif empty[row]:
                cells.append((no, lean, 1.0 / k_all, n, NO_EVIDENCE))
            else:
                g = int(tops[i]) if s[i] or not likely[row][lean] else lean
                cells.append((no, g, float(post[row][g]), n, None if s[i] else UNDECIDED))
        weights = np.bincount([c[1] for c in cells if c[1] is not None], weights=[c[3] for c in cells if c[1] is not None], minlength=k_all)
        main = int(weights.argmax()) if weights.any() else lean
        if main is None:
            out.append((None, 0.0, [], cells))
            continue
        plausible = [main] if s.any() else np.flatnonzero(together >= together[main] - undecided).tolist()
        share = sum(c[2] * max(c[3], 1) for c in cells if c[1] == main) / sum(max(c[3], 1) for c in cells)
        out.append((main, share, plausible, cells))
    return out


CELL = "struct<cell_no:int,lang:string,confidence:double,chars:int,reason:string>"


def detect(docs: DataFrame, languages: list[tuple[str, str]], params: LangParams = LangParams(), who: Identifier | None = None) -> DataFrame:
    """doc_id, label (language that ``lang`` names, or null), main, confidence, plausible, cells (cell_no, lang, confidence, chars, reason), one row
    per document with a text cell.

    docs: doc_id, text, lang, cells.  languages: (code, name) of all languages.  The models are trained on the driver from the bounded
    sample, and broadcast; their size is bounded by the sample's.  Scoring is a map over documents, without any shuffle but for inputs
    under SMALL bytes a core, which are spread first.
    """
    spark = docs.sparkSession
    who = who or train(sample(docs, languages, params), [c for c, _ in languages], params)
    shared = spark.sparkContext.broadcast(who)
    undecided = params.undecided

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = shared.value
        cell = pa.struct([("cell_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("chars", pa.int32()), ("reason", pa.string())])
        name = lambda g: None if g is None else who.languages[g]
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                bodies = [_bodies(t, c) for t, c in zip(batch.column("text").to_pylist(), batch.column("cells").to_pylist())]
                has = [i for i, b in enumerate(bodies) if b]
                found = judge(who, [bodies[i] for i in has], undecided)
                at = pa.array(has, pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(at), "label": batch.column("label").take(at),
                    "main": pa.array([name(m) for m, *_ in found], pa.string()), "confidence": pa.array([p for _, p, *_ in found], pa.float64()),
                    "plausible": pa.array([[name(g) for g in some] for _, _, some, _ in found], pa.list_(pa.string())),
                    "cells": pa.array([[{"cell_no": no, "lang": name(g), "confidence": p, "chars": n, "reason": why} for no, g, p, n, why in cells] for *_, cells in found], pa.list_(cell)),
                })

    rows = docs.select("doc_id", label_language(F.col("lang"), languages).alias("label"), "text", "cells")
    cores = spark.sparkContext.defaultParallelism
    if (known := file_bytes(docs)) and known < SMALL * cores:  # one small file would be one task
        rows = rows.repartition(cores)
    return rows.mapInArrow(run, f"doc_id bigint, label string, main string, confidence double, plausible array<string>, cells array<{CELL}>")


def label_cases(found: DataFrame) -> DataFrame:
    """doc_id, cell_no, lang: -1 and the main language where the label is missing, or is none of those that the evidence leaves open, and the
    cells in another language.  Rejected cells and documents without a language are no cases."""
    odd = F.col("main").isNotNull() & (F.col("label").isNull() | ~F.array_contains("plausible", F.col("label")))
    wrong = found.filter(odd).select("doc_id", F.lit(-1).alias("cell_no"), F.col("main").alias("lang"))
    cells = found.select("doc_id", "main", F.explode("cells").alias("c")).filter(F.col("c.lang") != F.col("main")).select("doc_id", "c.cell_no", "c.lang")
    return wrong.unionByName(cells)
