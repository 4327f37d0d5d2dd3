"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary.  The
probability of a word is the sum over all its segmentations into pieces, by a forward
algorithm that advances equally long words together; a text's is the product over its
words times the language's prior.  Piece probabilities are fitted by
expectation-maximisation on the word counts of a bounded sample of labelled documents:
about ``sample_docs`` whole documents of each language, chosen by a hash of the id.

Words are runs of letters, lower-cased.  Characters outside the vocabulary share one
piece.  Words of over 48 letters are scored in parts of 48: with the floor that every piece
has in every language, no product of so many pieces leaves the range of a double.  The
floor is the same in all languages, so letters that none has learned say nothing, and a text
of such letters alone gets the languages' prior.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties go to
the first language in order; with no labelled training document every text is ``und``;
repeated rows are scored alike; an empty table gives an empty result; extra columns are
ignored or kept, and never read; documents of one id are sampled by their texts too.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, unused
from .pieces import DEFAULT_MODEL, NORMAL, SPACE, Model, PieceIndex, by_length, codes, prefix_hashes

_LETTERS = re.compile(r"[^\W\d_]+")
_PART = 48


@dataclass(frozen=True)
class LanguageId:
    model: str = DEFAULT_MODEL
    #: Expected number of labelled documents of each language that the fit reads.
    sample_docs: int = 400
    rounds: int = 3
    #: Share of each language's probability that all pieces have in equal parts.
    floor: float = 0.003
    #: Languages with fewer labelled documents than this share of all are not learned, which
    #: bounds their number whatever the labels hold.
    min_share: float = 0.001
    #: A document is rejected if the log10 by which its best language explains a letter better
    #: than pieces that are all alike is less.  Short notices have about 0, words of letters
    #: that no language has learned -0.3 and less.
    min_gain: float = -0.2
    cache_words: int = 120_000


def words_of(text: str | None) -> list[str]:
    """The words with a separator before each; later parts of long ones have none."""
    found = [SPACE + w for w in _LETTERS.findall((text or "").lower())]
    if found and max(map(len, found)) > _PART:
        found = [w[k : k + _PART] for w in found for k in range(0, len(w), _PART)]
    return found


class Lattice:
    """The letters-only pieces of a vocabulary; the last number is for other characters."""

    def __init__(self, path: str):
        m = Model.load(path)
        texts = [p for p, kind in zip(m.pieces, m.kinds, strict=True) if kind == NORMAL and p == p.lower() and (q := p.removeprefix(SPACE)).isalpha() | (not q)]
        self.index = PieceIndex(texts, list(range(len(texts))))
        self.size = len(texts) + 1
        self.bare = texts.index(SPACE) if SPACE in texts else None

    def arcs(self, words: list[str], length: int):
        """(start, end, pieces) of every arc that some word of this length has."""
        h = prefix_hashes(codes(words, length))
        for end in range(1, length + 1):
            for k in range(1, min(self.index.longest, end) + 1):
                found = self.index.find(h, end - k, end)
                if k == 1:
                    found = np.where(found < 0, self.size - 1, found)
                if (found >= 0).any():
                    yield end - k, end, found


class LanguageModel:
    """Piece probabilities by language; ``log_words`` sums over all segmentations."""

    def __init__(self, languages: list[str], prior: np.ndarray, probabilities: np.ndarray, params: LanguageId):
        self.languages, self.prior, self.params = languages, prior, params
        self.probabilities = probabilities  # (pieces + 1) x languages; the last row, of no piece, is 0

    def __reduce__(self):
        return LanguageModel, (self.languages, self.prior, self.probabilities, self.params)

    #: Keeps the forward sums of words in range; taken out again at the end.
    LIFT = 256.0

    def log_words(self, lattice: Lattice, words: list[str]) -> np.ndarray:
        """By word: the natural logarithm in each language and, last, with all pieces alike."""
        p = np.column_stack([self.probabilities, np.full(len(self.probabilities), 1 / lattice.size)])
        p[-1] = 0
        out = np.empty((len(words), p.shape[1]))
        for length, places in by_length(words):
            group = [words[k] for k in places]
            alpha = np.zeros((length + 1, len(group), p.shape[1]))
            alpha[0] = 1
            for start, end, found in lattice.arcs(group, length):
                alpha[end] += alpha[start] * p[found] * self.LIFT ** (end - start)
            out[places] = np.log(alpha[length]) - length * np.log(self.LIFT)
        return out


def fit(counts: dict[str, Counter], documents: dict[str, int], params: LanguageId) -> LanguageModel:
    """Expectation-maximisation on word counts by language."""
    lattice = Lattice(params.model)
    languages = sorted(counts)
    total = sum(documents[k] for k in languages) or 1
    prior = np.log(np.array([documents[k] / total for k in languages])) if languages else np.zeros(0)
    words = sorted(set().union(*counts.values())) if languages else []
    weights = np.array([[counts[k].get(w, 0) for k in languages] for w in words], float).reshape(len(words), len(languages))
    marked = [SPACE + w for w in words]
    if not 1e-5 <= params.floor <= 1:
        raise ValueError("the floor must be within 0.00001 and 1")  # (floor / pieces * LIFT) ** 49 stays above 1e-308
    p = np.zeros((lattice.size + 1, len(languages)))
    p[:-1] = 1 / lattice.size
    groups = []
    for length, places in by_length(words, 20_000):
        arcs = [(a, b, f) for a, b, f in lattice.arcs([words[k] for k in places], length)]
        groups.append((length, weights[places], arcs))
    lift = LanguageModel.LIFT
    for _ in range(params.rounds if languages else 0):
        new = np.zeros_like(p)
        for length, weight, arcs in groups:
            alpha = np.zeros((length + 1, *weight.shape))
            beta = np.zeros_like(alpha)
            alpha[0] = beta[length] = 1
            for a, b, f in arcs:
                alpha[b] += alpha[a] * p[f] * lift ** (b - a)
            scale = weight / alpha[length]
            for a, b, f in reversed(arcs):  # by falling ends: beta[b] is complete
                step = p[f] * beta[b] * lift ** (b - a)
                beta[a] += step
                share = alpha[a] * step * scale
                for k in range(share.shape[1]):
                    new[:, k] += np.bincount(f % len(p), share[:, k], len(p))
        new[-1] = 0
        learned = new / np.maximum(new.sum(axis=0), 1e-9)
        if lattice.bare is not None:  # before letters that none has learned, it must say nothing either
            learned[lattice.bare] = learned[lattice.bare].mean()
            learned /= np.maximum(learned.sum(axis=0), 1e-9)
            learned[lattice.bare] = learned[lattice.bare].mean()
        p = learned * (1 - params.floor)
        p[:-1] += params.floor / lattice.size
    return LanguageModel(languages, prior, p, params)


def train(docs: DataFrame, is_training: Column, params: LanguageId = LanguageId()) -> LanguageModel:
    """Fit on about ``sample_docs`` labelled training documents of each language, whole texts."""
    labelled = docs.where(is_training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    least = labelled.count() * params.min_share
    documents = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().where(F.col("count") >= least).collect()}  # at most 1 / min_share
    if not documents:
        return fit({}, {}, params)
    rate = F.element_at(F.create_map(*(x for k, n in documents.items() for x in (F.lit(k), F.lit(min(1.0, params.sample_docs / n))))), F.col("lang"))
    chance = (F.xxhash64("doc_id", "text", F.lit("language")).bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)
    sample = labelled.where(chance < rate).select("lang", "text")

    def count(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text.as_py()))
            rows = [(k, w, n) for k, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "word": [r[1] for r in rows], "n": [r[2] for r in rows]}, pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    counts: dict[str, Counter] = {k: Counter() for k in documents}
    for r in sample.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    return fit(counts, documents, params)


class Scorer:
    def __init__(self, model: LanguageModel):
        self.model, self.lattice = model, Lattice(model.params.model)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages) + 1), np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, posterior probability, gain) of each text.

        The gain is the log10 by which a letter is likelier in the language than if all pieces
        were alike; below 0, the language is none that was learned.
        """
        m = self.model
        if not m.languages:
            return [("und", 0.0, 0.0)] * len(texts)
        block = [words_of(t) for t in texts]
        if len(self.rows) > m.params.cache_words:
            self.clear()
        new = list({w for words in block for w in words if w not in self.rows})
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.table = np.concatenate([self.table, m.log_words(self.lattice, new).astype(np.float32)])
        out = []
        for words in block:
            if not words:
                out.append(("und", 0.0, 0.0))
                continue
            rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            own = self.table[rows].sum(axis=0, dtype=np.float64)
            total = own[:-1] + m.prior
            if not np.isfinite(total).all():
                raise ArithmeticError("a text has no finite probability")
            odds = np.exp(total - total.max())
            k = int(odds.argmax())
            out.append((m.languages[k], float(min(1.0, odds[k] / odds.sum())), float((own[k] - own[-1]) / np.log(10) / sum(map(len, words)))))
        return out


def identify(docs: DataFrame, model: LanguageModel, columns: list[str], language: str = "lang_pred", score: str = "score", gain: str = "gain") -> DataFrame:
    """``columns`` of ``docs`` with the predicted language, its score and gain; only ``text`` is read."""
    source = docs.select(*columns, F.col("text").alias("_text_")) if "text" not in columns else docs.select(*columns)
    at = source.columns.index("text" if "text" in columns else "_text_")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: pieces x languages

    def run(batches):
        scorer = Scorer(shared.value)
        for whole in batches:
            start = 0
            sizes = pc.binary_length(whole.column(at)).to_pylist()
            while start < whole.num_rows or not whole.num_rows:
                stop, size = start, 0
                while stop < whole.num_rows and (size < 2_000_000 or stop == start):
                    size += sizes[stop] or 0
                    stop += 1
                batch = whole.slice(start, stop - start)
                found = scorer.predict(batch.column(at).to_pylist())
                own = [batch.column(k) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64())))], [*columns, language, score, gain])
                start = stop
                if not whole.num_rows:
                    break

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", {language} string, {score} double, {gain} double")


def predict_languages(docs: DataFrame, params: LanguageId = LanguageId(), folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); documents whose id's crc32 is 0 mod ``folds`` are not learned from."""
    held = crc_remainder(F.col("doc_id"), folds) == 0
    model = train(docs, ~held, params)
    return identify(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, params: LanguageId = LanguageId(), languages: set[str] | None = None) -> DataFrame:
    """The documents in one of ``languages`` (default: any learned one); columns unchanged.

    What goes: text without letters; text that no learned language explains better than
    pieces that are all alike (``min_gain``); and, if ``languages`` is given, other languages.
    """
    model = train(docs, F.lit(True), params)
    names = [unused(docs, c) for c in ("lang_pred", "lang_score", "lang_gain")]
    found = identify(docs, model, docs.columns, *names)
    wanted = model.languages if languages is None else sorted(languages)
    return found.where(F.col(names[0]).isin(wanted) & (F.col(names[2]) >= params.min_gain) if wanted else F.lit(False)).select(*docs.columns)
