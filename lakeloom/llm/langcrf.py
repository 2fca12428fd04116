"""Language identification by a linear-chain conditional random field over words.

Each word has features: its byte trigrams with the white space around it (which include the
affixes of two), its prefix and suffix of three, and itself in a hashed lexicon. Their learned
weights are the word's score for each language, and learned transitions tie it to its
neighbours, so that runs of several languages in one text are told apart. Forward-backward gives
every word's marginals; a document's score for a language is the mean of its words' marginals.

A whole batch is one chain: at a document's first word the transition is replaced by the start
weights, which cuts it. The chain is run as blocks side by side: products of the transition
matrices within each block, then the states between blocks, then the states inside them. That is
exact forward-backward, without approximation at block borders.

Training takes a bounded sample: at most ``docs_per_language`` documents of each language,
``sample_chars`` characters from a place of each chosen by hash. Sequences are made of spans of
different languages, so that transitions are learned from code-switched text.

Defined results: null texts and texts without a letter are ``und`` with score 0; words without
letters carry no score and do not count; null languages are not learned; repeated rows are
labelled each; with no labelled text at all everything is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import find_words, fresh_names, hash_words, lower_ascii, spans_of, text_blocks

TRIGRAMS, AFFIXES, LEXICON = 1 << 15, 1 << 14, 1 << 16
SIZE = TRIGRAMS + 2 * AFFIXES + LEXICON
BLOCK = 128
SCORED_BYTES = 1 << 18  # of text at a time: scoring takes some 80 bytes for each
SQUARE = np.uint32(65599 * 65599 % (1 << 32))
NO_LANGUAGE = "und"


def features(buffer: np.ndarray):
    """(word starts, trigram features, first trigram of each word, three word features, has letters) of a buffer."""
    low = lower_ascii(buffer)
    low = np.where((low >= 9) & (low <= 13), 32, low).astype(np.uint32)
    first, last = find_words(buffer)
    edge = np.concatenate([[np.uint32(32)], low, [np.uint32(32)] * 3]).astype(np.uint32)  # edge[p] is the byte before p
    tri = edge[:-2] * SQUARE + edge[1:-1] * np.uint32(65599) + edge[2:]
    tri = (tri ^ (tri >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    tri = (tri >> np.uint32(17)) % np.uint32(TRIGRAMS)
    size = last - first
    starts = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(starts[-1]) + np.repeat(first - starts[:-1], size)
    grams = tri[place].astype(np.int32)
    three = lambda at: edge[at + 1] * SQUARE + edge[at + 2] * np.uint32(65599) + edge[at + 3]
    prefix, suffix = three(first), three(np.maximum(last - 3, first - 1))
    squeeze = lambda x: ((x * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64)
    lexicon = (hash_words(low.astype(np.uint8), first, last) >> np.uint64(40)) % np.uint64(LEXICON)
    own = np.stack([TRIGRAMS + squeeze(prefix), TRIGRAMS + AFFIXES + squeeze(suffix), TRIGRAMS + 2 * AFFIXES + lexicon.astype(np.int64)])
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    known = np.concatenate([[0], np.cumsum(letter)])
    return first, grams, starts, own, known[last] > known[first]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray
    start: np.ndarray

    def scores(self, grams, starts, own, letters) -> np.ndarray:
        n = len(starts) - 1
        if not n:
            return np.zeros((0, len(self.languages)), np.float32)
        total = np.add.reduceat(self.weights[grams], starts[:-1], axis=0)
        total += self.weights[own[0]] + self.weights[own[1]] + self.weights[own[2]]
        total[~letters] = 0
        return total


def chain_marginals(scores: np.ndarray, begins: np.ndarray, transitions: np.ndarray, start: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Marginals of every word. begins: True where a word is the first of its text."""
    n, labels = scores.shape
    if not n:
        return scores
    blocks = -(-n // block)
    pad = blocks * block - n
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    e = np.concatenate([e, np.ones((pad, labels))]).reshape(blocks, block, labels)
    b = np.concatenate([begins, np.ones(pad, bool)]).reshape(blocks, block)
    b[0, 0] = True
    t, s = np.exp(transitions.astype(np.float64)), np.exp(start.astype(np.float64))
    cuts = [np.flatnonzero(b[:, i]) for i in range(block)]
    product = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
    for i in range(block):
        step = (product.reshape(-1, labels) @ t).reshape(blocks, labels, labels)
        if len(cuts[i]):
            step[cuts[i]] = product[cuts[i]].sum(2, keepdims=True) * s
        step *= e[:, i, None, :]
        product = step / step.sum((1, 2), keepdims=True)
    into = np.empty((blocks, labels))
    state = np.full(labels, 1 / labels)
    for k in range(blocks):
        into[k] = state
        state = state @ product[k]
        state = state / state.sum()
    back = np.empty((blocks, labels))
    state = np.ones(labels)
    for k in range(blocks - 1, -1, -1):
        back[k] = state
        state = product[k] @ state
        state = state / state.sum()
    forward = np.empty((blocks, block, labels))
    now = into
    for i in range(block):
        after = now @ t
        if len(cuts[i]):
            after[cuts[i]] = now[cuts[i]].sum(1, keepdims=True) * s
        after *= e[:, i]
        now = after / after.sum(1, keepdims=True)
        forward[:, i] = now
    now = back
    for i in range(block - 1, -1, -1):
        here = forward[:, i] * now
        forward[:, i] = here / here.sum(1, keepdims=True)
        weighed = e[:, i] * now
        before = weighed @ t.T
        if len(cuts[i]):
            before[cuts[i]] = (weighed[cuts[i]] @ s)[:, None]
        now = before / before.sum(1, keepdims=True)
    return forward.reshape(-1, labels)[:n]


def train(texts: list[tuple[str, str]], epochs: int = 25, rate: float = 0.4, length: int = 64, seed: int = 5) -> Model:
    """texts: (text, language). AdaGrad on the conditional likelihood of sequences of code-switched spans."""
    languages = sorted({lang for _, lang in texts})
    labels, rng = len(languages), np.random.default_rng(seed)
    spans: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {i: [] for i in range(labels)}
    for text, lang in sorted(texts):
        _, grams, starts, own, letters = features(np.frombuffer(text.encode() + b"\n", np.uint8))
        keep = np.flatnonzero(letters)
        at = 0
        while at < len(keep):
            take = keep[at : at + int(rng.integers(4, 48))]
            at += len(take)
            spans[languages.index(lang)].append((take, grams, starts, own))
    order = [(i, s) for i in spans for s in spans[i]]
    rng.shuffle(order)
    y = np.concatenate([np.full(len(s[0]), i) for i, s in order]) if order else np.zeros(0, int)
    n = len(y) // length * length
    gram_list, sizes, owns = [], [], []
    for _, (take, grams, starts, own) in order:
        for w in take:
            gram_list.append(grams[starts[w] : starts[w + 1]])
        sizes.append(starts[take + 1] - starts[take])
        owns.append(own[:, take])
    weights, transitions, start = np.zeros((SIZE, labels), np.float32), np.zeros((labels, labels)), np.zeros(labels)
    if not n:
        return Model(languages, weights, transitions, start)
    y = y[:n].reshape(-1, length)
    size = np.concatenate(sizes)[:n]
    grams = np.concatenate(gram_list[:n])
    own = np.concatenate(owns, axis=1)[:, :n]
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    word_of = np.repeat(np.arange(n), size)
    truth = np.eye(labels)[y]
    seen = [np.full(a.shape, 1e-2) for a in (weights, transitions, start)]
    everywhere = np.concatenate([grams, own[0], own[1], own[2]])
    owner = np.concatenate([word_of, *[np.arange(n)] * 3])
    for _ in range(epochs):
        score = np.add.reduceat(weights[grams], begin, axis=0) + weights[own[0]] + weights[own[1]] + weights[own[2]]
        e = np.exp(score - score.max(1, keepdims=True)).astype(np.float64).reshape(-1, length, labels)
        t, s = np.exp(transitions), np.exp(start)
        forward, scale = np.empty_like(e), None
        now = s * e[:, 0]
        forward[:, 0] = now / now.sum(1, keepdims=True)
        for i in range(1, length):
            now = (forward[:, i - 1] @ t) * e[:, i]
            forward[:, i] = now / now.sum(1, keepdims=True)
        marginal, now, pairs = np.empty_like(e), np.ones((len(e), labels)), np.zeros((labels, labels))
        for i in range(length - 1, -1, -1):
            here = forward[:, i] * now
            marginal[:, i] = here / here.sum(1, keepdims=True)
            if i:
                weighed = e[:, i] * now
                joint = forward[:, i - 1, :, None] * t * weighed[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                now = weighed @ t.T
                now /= now.sum(1, keepdims=True)
        off = (truth - marginal).reshape(n, labels)
        gradient = np.stack([np.bincount(everywhere, off[owner, c], SIZE) for c in range(labels)], 1) - 1e-3 * weights
        real = np.zeros((labels, labels))
        np.add.at(real, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        steps = (gradient, (real - pairs) - 1e-3 * transitions, (truth[:, 0] - marginal[:, 0]).sum(0) - 1e-3 * start)
        for a, g, h in zip((weights, transitions, start), steps, seen, strict=True):
            h += g * g
            a += (rate * g / np.sqrt(h)).astype(a.dtype)
    return Model(languages, weights, transitions, start)


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, language, marginal) of a possibly code-switched text."""
    raw = np.frombuffer(text.encode() + b"\n", np.uint8)
    first, grams, starts, own, letters = features(raw)
    begins = np.zeros(len(first), bool)
    begins[:1] = True
    m = chain_marginals(model.scores(grams, starts, own, letters), begins, model.transitions, model.start)
    _, last = find_words(raw)
    return [(raw[a:b].tobytes().decode(), model.languages[int(p.argmax())] if k else NO_LANGUAGE, float(p.max()) if k else 0.0) for a, b, p, k in zip(first, last, m, letters, strict=True)]


def training_sample(labelled: DataFrame, docs_per_language: int = 150, sample_chars: int = 3000) -> list[tuple[str, str]]:
    """A bounded sample of (text, language): the documents with the smallest hashes among those under a rate that fits each language's count."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language, as the model has a column for each
    if not counts:
        return []
    key = F.xxhash64("text")
    place = F.shiftrightunsigned(key, 33) / F.lit(2.0**31)
    from_ = (F.greatest(F.lit(0), F.length("text") - sample_chars) * F.pmod(key, F.lit(1000)) / 1000).cast("int") + 1
    # one flat map, whatever the number of languages: a chain of cases would nest as deep as there are languages
    rates = F.map_from_arrays(F.array(*(F.lit(r["lang"]) for r in counts)), F.array(*(F.lit(min(1.0, 1.3 * docs_per_language / r["n"])) for r in counts)))
    share = F.try_element_at(rates, F.col("lang"))
    rows = labelled.filter(place < share).select("lang", key.alias("key"), F.substring(F.col("text"), from_, F.lit(sample_chars)).alias("text"))
    first = rows.distinct().withColumn("__r", F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))).filter(F.col("__r") <= docs_per_language)
    taken: dict[str, set[str]] = {}
    for r in first.collect():  # at most docs_per_language for each language
        taken.setdefault(r["lang"], set()).add(r["text"])
    return [(t, lang) for lang in sorted(taken) for t in sorted(taken[lang])]


def identify_languages(spark: SparkSession, docs: DataFrame, model: Model, carry: tuple = (), result: tuple = ("lang_pred", "score")) -> DataFrame:
    """The carried columns of docs (doc_id by default), and the language and its score under the two names.

    Only the text goes to Python and only the two results come back, whatever is carried.
    """
    import pyarrow as pa

    carry = carry or ("doc_id",)
    found_name, letter_name = fresh_names([*carry, *result], "__found", "__letter")
    handle = spark.sparkContext.broadcast(model)

    def scan(columns):
        model = handle.value
        labels = len(model.languages)
        for column in columns:
            names, scores = [], []
            for _, k, buffer, starts in text_blocks(column, SCORED_BYTES):
                if not labels:
                    names += [NO_LANGUAGE] * k
                    scores += [0.0] * k
                    continue
                first, grams, begin, own, letters = features(buffer)
                at = spans_of(starts, first)
                begins = np.zeros(len(first), bool)
                begins[at[:-1][at[:-1] < at[1:]]] = True
                m = chain_marginals(model.scores(grams, begin, own, letters), begins, model.transitions, model.start)
                total = np.concatenate([np.zeros((1, labels)), np.cumsum(np.where(letters[:, None], m, 0), axis=0)])
                count = np.concatenate([[0], np.cumsum(letters)])
                mean = (total[at[1:]] - total[at[:-1]]) / np.maximum(1, count[at[1:]] - count[at[:-1]])[:, None]
                names += [model.languages[i] for i in mean.argmax(1).tolist()]
                scores += np.clip(mean.max(1), 0.0, 1.0).tolist()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    # as nondeterministic it is not run again for a filter on its result
    identify = F.arrow_udf(scan, "struct<lang string, score double>", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    found = docs.select(*carry, identify(F.col("text")).alias(found_name), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(letter_name))
    lang = F.when(F.col(letter_name), F.col(f"{found_name}.lang")).otherwise(F.lit(NO_LANGUAGE))
    score = F.when(F.col(letter_name), F.col(f"{found_name}.score")).otherwise(F.lit(0.0))
    return found.select(*carry, lang.alias(result[0]), score.alias(result[1]))


def held_out(id_column: str = "doc_id"):
    """True for documents whose crc32 of the id as text has remainder 2 by 4."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), F.lit(4)) == 2


def train_on(docs: DataFrame, **options) -> Model:
    """A model from the text and lang of the documents that are not held out."""
    labelled = docs.filter(~held_out()).filter("lang is not null and text is not null").select("text", "lang")
    return train(training_sample(labelled, **options))
