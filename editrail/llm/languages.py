"""Language of documents, and of the blocks of documents in several languages.

One interpolated Kneser-Ney model of characters per language, over words with their boundaries. Each
order is a sorted array of 64-bit n-gram hashes beside the n-grams' discounted probabilities, and one of
context hashes beside the contexts' back-off weights. A text has the language of the lowest
cross-entropy per character. Two numbers are calibrated on held-out labelled text: a temperature, which
turns the differences of cross-entropy into a confidence, on pieces short enough to be mistaken; and
a bound on the cross-entropy itself, beyond which a text is in none of the languages, by leaving out
each language in turn.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editrail.runtime import read_table, small, spread

LANGUAGES = ("en", "es", "fr", "de", "pt", "it")
ORDER = 5
#: Characters of labelled text that one language's model is fitted on, at most; the only bounded sample here.
TRAINING_CHARS = 400_000
#: Labelled documents per language in the sample, at most (twice, where a hash level must be taken whole).
TRAINING_DOCS = 240
#: With fewer reviewed documents than this in a language, documents' own labels help out.
ENOUGH_DOCS = 60
#: Letters from which a block of a mixed document is labelled by itself.
BLOCK_LETTERS = 60
#: Distinct words whose scores a worker keeps; beyond it the memory starts anew. No result depends on it.
MEMORY_WORDS = 200_000

_WORDS = re.compile(r"[^\W\d_]+").findall
_BLANK_LINES = re.compile(r"\r?\n(?:[^\S\n]*\n)+").split
_QUOTED = re.compile(r"\"[^\"]+\"|“[^”]+”|«[^»]+»|„[^“”]+[“”]")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def blocks_of(text: str) -> list[str]:
    """Stretches of non-blank lines; lines end in LF or CRLF."""
    text = text.strip()
    return _BLANK_LINES(text) if text else []


def spoken(block: str) -> list[str]:
    """Lower-cased words outside quotation marks, or all words if hardly any is outside."""
    if '"' in block or "“" in block or "«" in block or "„" in block:
        own = _WORDS(_QUOTED.sub(" ", block).lower())
        if sum(map(len, own)) >= 20:
            return own
    return _WORDS(block.lower())


def _ngrams(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """By n: hashes of the n-gram ending at each character (0 where the word has none); its word; hashes of its history.

    Words are read with a boundary on either side; the first boundary is history only.
    """
    joined = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    starts = np.flatnonzero(codes == 2)
    word = np.cumsum(codes == 2) - 1
    place = np.arange(len(codes)) - starts[word]
    grams = [codes * _MIX ^ (codes >> np.uint64(7)) + np.uint64(1)]
    for n in range(2, order + 1):
        longer = np.zeros_like(codes)
        before = grams[-1][:-1] * np.uint64(6364136223846793005) + np.uint64(n)
        longer[1:] = (before ^ (before >> np.uint64(29))) * _MIX + codes[1:]
        longer[place < n - 1] = 0
        grams.append(longer)
    said = place > 0
    contexts = [np.zeros(int(said.sum()), dtype=np.uint64)] + [g[np.flatnonzero(said) - 1] for g in grams[:-1]]
    return [g[said] for g in grams], word[said], contexts


class KneserNey:
    """The model of one language."""

    def __init__(self, counts: Counter, symbols: int, order: int = ORDER):
        self.symbols, self.grams, self.contexts = symbols, [], []
        words = sorted(counts)
        if not words:
            return
        grams, word, contexts = _ngrams(words, order)
        weight = np.array([counts[w] for w in words], dtype=np.float64)[word]
        for n in range(order):
            here = grams[n] != 0
            g, c = grams[n][here], contexts[n][here]
            if n < order - 1:
                # continuation counts: in how many ways an n-gram is preceded; those at a word's start keep their counts
                longer = grams[n + 1][here]
                first = longer == 0
                _, one = np.unique(longer[~first], return_index=True)
                g2, c2 = np.concatenate([g[~first][one], g[first]]), np.concatenate([c[~first][one], c[first]])
                w2 = np.concatenate([np.ones(len(one)), weight[here][first]])
            else:
                g2, c2, w2 = g, c, weight[here]
            keys, at, back = np.unique(g2, return_index=True, return_inverse=True)
            n_of = np.bincount(back, weights=w2)
            ctx, c_back = np.unique(c2[at], return_inverse=True)
            total = np.bincount(c_back, weights=n_of)
            ones, twos = (n_of == 1).sum(), (n_of == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            kinds = np.bincount(c_back)
            self.grams.append((keys, (np.maximum(n_of - d, 0) / total[c_back])))
            self.contexts.append((ctx, np.minimum(1.0, np.minimum(d, 1) * kinds / total)))

    def log_probabilities(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(grams[0]), 1.0 / self.symbols)
        for n, ((keys, alpha), (ctx, weight)) in enumerate(zip(self.grams, self.contexts)):
            at = np.minimum(np.searchsorted(ctx, contexts[n]), len(ctx) - 1)
            known = (ctx[at] == contexts[n]) & (grams[n] != 0)
            to = np.minimum(np.searchsorted(keys, grams[n]), len(keys) - 1)
            own = np.where(known & (keys[to] == grams[n]), alpha[to], 0.0)
            p = np.where(known, own + weight[at] * p, p)
        return np.log(p)


class Labeller:
    """Models of all languages, the temperature of their confidence, and the bound beyond which a text is in none of them.

    The bound on a text of n characters is bound[0] + bound[1] / sqrt(n): short texts scatter more.
    """

    def __init__(self, counts: dict[str, Counter], order: int = ORDER):
        self.languages, self.order, self.temperature = [c for c in LANGUAGES if counts.get(c)], order, 1.0
        self.bound, self.errors = (float("inf"), 0.0), (0.0, 0.0)
        symbols = len({ch for c in counts.values() for w in c for ch in w}) + 2
        self.models = [KneserNey(counts[c], symbols, order) for c in self.languages]
        self._index: dict[str, int] = {}
        self._scores = np.zeros((0, len(self.models)))

    def __getstate__(self):
        return self.__dict__ | {"_index": {}, "_scores": np.zeros((0, len(self.models)))}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): log-probability of each word's characters and its end."""
        grams, word, contexts = _ngrams(words, self.order)
        return np.stack([np.bincount(word, weights=m.log_probabilities(grams, contexts), minlength=len(words)) for m in self.models], axis=1)

    def texts(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) of summed log-probabilities, and characters with word ends of each text."""
        if len(self._index) > MEMORY_WORDS:
            self._index, self._scores = {}, self._scores[:0]
        index = self._index
        new = list({w for t in texts for w in t if w not in index})
        if new:
            self._scores = np.concatenate([self._scores, self.word_scores(new)])
            for w in new:
                index[w] = len(index)
        flat = np.fromiter((index[w] for t in texts for w in t), dtype=np.int64)
        sizes = np.array([len(t) for t in texts])
        sums = np.zeros((len(texts), len(self.models)))
        some = np.flatnonzero(sizes)
        if len(flat):
            sums[some] = np.add.reduceat(self._scores[flat], (np.cumsum(sizes) - sizes)[some])
        return sums, np.array([sum(map(len, t)) + len(t) for t in texts])

    @staticmethod
    def entropies(sums: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """(texts, languages): cross-entropy per character, in nats."""
        return -sums / np.maximum(chars, 1)[:, None]

    def confidences(self, entropy: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Of each language: the lower its cross-entropy and the longer the text, the surer, by the fitted temperature."""
        z = -(entropy - entropy.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(chars, 1))[:, None] / self.temperature
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)

    def foreign(self, entropy: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Whether each text is unlike all the languages."""
        return entropy.min(axis=1) > self.bound[0] + self.bound[1] / np.sqrt(np.maximum(chars, 1))

    def fit_temperature(self, texts: list[list[str]], truth: list[str]) -> None:
        """The temperature of the least log loss over labelled texts, some of which must be short enough to be mistaken."""
        keep = [k for k, t in enumerate(truth) if t in self.languages and texts[k]]
        if not keep:
            return
        sums, chars = self.texts([texts[k] for k in keep])
        entropy = self.entropies(sums, chars)
        right = np.array([self.languages.index(truth[k]) for k in keep])

        def loss(t: float) -> float:
            self.temperature = t
            return -np.log(np.maximum(self.confidences(entropy, chars)[np.arange(len(right)), right], 1e-12)).mean()

        self.temperature = min((2.0 ** (k / 4) for k in range(-24, 25)), key=loss)

    def fit_bound(self, texts: list[list[str]], truth: list[str]) -> None:
        """The bound of the fewest errors: own-language texts refused, and texts let through whose language is left out in turn.

        errors: the two shares at the bound, on the texts it is fitted on.
        """
        keep = [k for k, t in enumerate(truth) if t in self.languages and texts[k]]
        if not keep or len(self.languages) < 2:
            return
        sums, chars = self.texts([texts[k] for k in keep])
        entropy = self.entropies(sums, chars)
        own = np.array([self.languages.index(truth[k]) for k in keep])
        known = entropy.min(axis=1)
        others = entropy.copy()
        others[np.arange(len(own)), own] = np.inf
        unknown = others.min(axis=1)
        root = 1 / np.sqrt(np.maximum(chars, 1))
        best = None
        for slope in np.linspace(0, 4, 17):
            a, b = np.sort(known - slope * root), np.sort(unknown - slope * root)
            cuts = np.concatenate([a, b])
            refused = 1 - np.searchsorted(a, cuts, side="right") / len(a)
            passed = np.searchsorted(b, cuts, side="right") / len(b)
            k = int((refused + passed).argmin())
            if best is None or refused[k] + passed[k] < best[0]:
                # midway to the next value, so that neither side lies on the bound
                after = np.concatenate([a[a > cuts[k]][:1], b[b > cuts[k]][:1], [cuts[k] + 1e-9]])
                best = (refused[k] + passed[k], (float((cuts[k] + after.min()) / 2), float(slope)), (float(refused[k]), float(passed[k])))
        _, self.bound, self.errors = best


def pieces(words: list[str], sizes: tuple[int, ...] = (1, 2, 3, 5, 8, 13)) -> list[list[str]]:
    """The words cut into runs of these sizes in turn: held-out texts short enough that some are mistaken."""
    out, at, k = [], 0, 0
    while at < len(words):
        out.append(words[at : at + sizes[k % len(sizes)]])
        at, k = at + sizes[k % len(sizes)], k + 1
    return out


def code(label):
    """A label as a code: case and anything from the first - or _ on don't count."""
    return F.lower(F.regexp_extract(label, r"^\s*([^-_]*?)\s*(?:[-_].*)?$", 1))


def _level(key):
    """0 for half of all keys, 1 for a quarter, 2 for an eighth, and so on, by a hash: thins any table alike."""
    return F.floor(-F.log2((F.xxhash64(key).bitwiseAND(F.lit((1 << 53) - 1)) + 1) / F.lit(float(1 << 53)))).cast("int")


def _thinned(rows: DataFrame, most: int) -> DataFrame:
    """doc_id, lang of at most `most` rows per language where hash levels allow, of at least one level."""
    rows = rows.withColumn("level", _level("doc_id"))
    kept: dict[str, tuple[int, int]] = {}
    for r in sorted(rows.groupBy("lang", "level").count().collect(), key=lambda r: -r["level"]):
        n, _ = kept.get(r["lang"], (0, 0))
        if not n or n + r["count"] <= most:
            kept[r["lang"]] = (n + r["count"], r["level"])
    wanted = F.lit(False)
    for lang, (_, level) in kept.items():
        wanted = wanted | ((F.col("lang") == lang) & (F.col("level") >= level))
    return rows.where(wanted).select("doc_id", "lang")


def training_sample(docs: DataFrame, labels: DataFrame, most_docs: int = TRAINING_DOCS, enough_docs: int = ENOUGH_DOCS) -> list[tuple[str, str, bool]]:
    """(text, language, reviewed) of a bounded sample of labelled documents, for the driver to fit on.

    By a hash of the id, about most_docs reviewed documents per language at most; where fewer than
    enough_docs are reviewed, as many more by their own label. Contradicting reviews: the least code.
    """
    reviewed = labels.select("doc_id", code(F.col("lang")).alias("lang")).where(F.col("lang").isin(*LANGUAGES))
    reviewed = _thinned(reviewed.groupBy("doc_id").agg(F.min("lang").alias("lang")), most_docs)
    n = {r["lang"]: r["count"] for r in reviewed.groupBy("lang").count().collect()}
    picked = reviewed.withColumn("reviewed", F.lit(True))
    few = [c for c in LANGUAGES if n.get(c, 0) < enough_docs]
    if few:
        own = docs.select("doc_id", code(F.col("lang")).alias("lang")).where(F.col("lang").isin(*few))
        own = _thinned(own.join(labels.select("doc_id"), "doc_id", "left_anti"), enough_docs)
        picked = picked.unionByName(own.withColumn("reviewed", F.lit(False)))
    # bounded by the two parameters and the number of languages: small() counts it, and it may be collected
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(small(picked), "doc_id").select("doc_id", "text", "lang", "reviewed")
    return [(r["text"], r["lang"], r["reviewed"]) for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"]))]


def fit(sample: list[tuple[str, str, bool]], order: int = ORDER, most_chars: int = TRAINING_CHARS) -> Labeller | None:
    """A labeller from labelled texts. Unreviewed texts that a first model contradicts are left out of the second."""
    words = [[spoken(_TAG.sub(" ", b)) for b in blocks_of(t)] for t, _, _ in sample]

    def count(rows: list[int]) -> dict[str, Counter]:
        counts: dict[str, Counter] = {}
        chars: Counter = Counter()
        for k in sorted(rows, key=lambda k: not sample[k][2]):
            lang = sample[k][1]
            if chars[lang] < most_chars:
                for w in words[k]:
                    counts.setdefault(lang, Counter()).update(w)
                    chars[lang] += sum(map(len, w))
        return {c: n for c, n in counts.items() if n}

    rows = list(range(len(sample)))
    if not count(rows):
        return None
    first = Labeller(count(rows), order)
    whole = [[w for b in t for w in b] for t in words]
    best = first.texts(whole)[0].argmax(axis=1)
    rows = [k for k in rows if whole[k] and (sample[k][2] or first.languages[best[k]] == sample[k][1])]
    held = [k for i, k in enumerate(rows) if i % 5 == 0 and sample[k][2]]
    final = Labeller(count(rows), order)
    rest = count([k for k in rows if k not in set(held)])
    if held and len(rest) == len(final.languages):
        part = Labeller(rest, order)
        cut = [(piece, sample[k][1]) for k in held for b in words[k] for piece in pieces(b)]
        part.fit_temperature([p for p, _ in cut], [c for _, c in cut])
        blocks = [(b, sample[k][1]) for k in held for b in words[k] if sum(map(len, b)) >= BLOCK_LETTERS]
        part.fit_bound([b for b, _ in blocks], [c for _, c in blocks])
        final.temperature, final.bound, final.errors = part.temperature, part.bound, part.errors
    return final


SCHEMA = "doc_id long, label string, block_no int, letters long, lang string, confidence double, mixed boolean, foreign boolean"


def label_blocks(docs: DataFrame, labeller: Labeller) -> DataFrame:
    """Language and confidence of every document with words (block_no 0) and of every block with words.

    doc_id, label (the document's own, as it stands), block_no, letters, lang, confidence, mixed:
    whether the document's blocks of at least BLOCK_LETTERS letters are in more than one language; foreign: whether
    the text (of a document, most of its letters) is less like any of the languages than held-out text of theirs.
    A document's language is that of most of its letters; its confidence, their share weighed by the
    blocks' confidences. Null and blank texts, and those without letters outside tags, have no rows. Repeated rows
    are labelled each; whole texts are read; extra columns aren't. One scan, no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(labeller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                yield label(m, part.column(0), part.column(1), part.column(2).to_pylist())

    def label(m: Labeller, ids: pa.Array, labels: pa.Array, texts: list) -> pa.RecordBatch:
        doc, no, letters, said = [], [], [], []
        for d, t in enumerate(texts):
            for k, b in enumerate(blocks_of(t) if t else [], 1):
                if "<" in b:
                    b = _TAG.sub(" ", b)
                n = sum(map(len, _WORDS(b)))
                if n:
                    doc.append(d)
                    no.append(k)
                    letters.append(n)
                    said.append(spoken(b))
        doc, no, letters = np.array(doc, dtype=np.int64), np.array(no, dtype=np.int32), np.array(letters, dtype=np.int64)
        if not len(doc):
            return pa.RecordBatch.from_pylist([], schema=ARROW)
        sums, chars = m.texts(said)
        entropy = m.entropies(sums, chars)
        best, sure = entropy.argmin(axis=1), m.confidences(entropy, chars)
        unlike = m.foreign(entropy, chars)
        strange = np.bincount(doc, weights=letters * unlike, minlength=len(texts))
        by_lang = np.zeros((len(texts), len(m.languages)))
        np.add.at(by_lang, (doc, best), letters)
        trust = np.zeros_like(by_lang)
        np.add.at(trust, (doc, best), letters * sure[np.arange(len(doc)), best])
        long = letters >= BLOCK_LETTERS
        seen = np.zeros(by_lang.shape, dtype=bool)
        seen[doc[long], best[long]] = True
        mixed = seen.sum(axis=1) > 1
        docs_in = np.unique(doc)
        main = by_lang[docs_in].argmax(axis=1)
        total = by_lang[docs_in].sum(axis=1)
        at = np.concatenate([docs_in, doc])
        names = np.array(m.languages, dtype=object)
        cols = [
            ids.take(pa.array(at)),
            labels.take(pa.array(at)),
            pa.array(np.concatenate([np.zeros(len(docs_in), dtype=np.int32), no])),
            pa.array(np.concatenate([total.astype(np.int64), letters])),
            pa.array(names[np.concatenate([main, best])], pa.string()),
            pa.array(np.concatenate([trust[docs_in, main] / total, sure[np.arange(len(doc)), best]])),
            pa.array(mixed[at]),
            pa.array(np.concatenate([2 * strange[docs_in] > total, unlike])),
        ]
        return pa.RecordBatch.from_arrays(cols, schema=ARROW)

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("lang").alias("label"), "text")).mapInArrow(run, SCHEMA)


ARROW = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("block_no", pa.int32()), ("letters", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("mixed", pa.bool_()), ("foreign", pa.bool_())])


def document_languages(docs: DataFrame, labels: DataFrame, reject_below: float = 0.0, reject_foreign: bool = False) -> DataFrame:
    """label_blocks() by models fitted on a bounded sample; blocks other than those of mixed documents left out.

    Rows of a confidence below reject_below have a null language, and with reject_foreign those beyond the calibrated
    bound too. Without any labelled text all have.
    """
    labeller = fit(training_sample(docs, labels))
    if labeller is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    out = label_blocks(docs, labeller).where(f"block_no = 0 OR (mixed AND letters >= {BLOCK_LETTERS})")
    refused = F.col("confidence") < reject_below
    if reject_foreign:
        refused = refused | F.col("foreign")
    return out.withColumn("lang", F.when(~refused, F.col("lang")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case has one of the six codes, so nothing is rejected here; p8_languages rejects."""
    rows = document_languages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "lang_labels"))
    right = F.coalesce(code(F.col("label")) == F.col("lang"), F.lit(False))
    return rows.where((F.col("block_no") > 0) | ~right).select("doc_id", "block_no", "lang")


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every block of a mixed one, with its confidence; lang is null beyond the calibrated bound."""
    rows = document_languages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "lang_labels"), reject_foreign=True)
    return rows.select("doc_id", "block_no", "lang", "confidence")
