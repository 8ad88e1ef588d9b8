"""The two classifiers a second time, by loops over characters and dictionaries, without arrays."""

import math
import random
from collections import Counter

import pytest

from gridcast.llm import language, toxicity

MIX, WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1


def hashed(gram):
    code = 0
    for k, letter in enumerate(gram, 1):
        code = ((code * MIX) & WORD) ^ (letter + k)
    return (code * MIX) & WORD


# ------------------------------------------------------------------ toxicity


def grams(text):
    """Buckets of all runs of 3 to 5 characters in which white space stands at most at the ends."""
    if not text:
        return set()
    points = [32 if c in " \t\n\v\f\r" else ord(c) for c in (" " + text + " ").lower()]
    return {hashed(points[i:i + n]) >> 46 for n in (3, 4, 5) for i in range(len(points) - n + 1) if 32 not in points[i + 1:i + n - 1]}


def plain_toxicity(rows, labels):
    """Scores of any text by a classifier of these rows: ratios, and the same number of accelerated gradient steps."""
    held = [grams(t) for t in rows]
    counts = {v: Counter(g for h, label in zip(held, labels) if label == v for g in h) for v in (0, 1)}
    n = {v: 2 + labels.count(v) for v in (0, 1)}

    def ratio(g):
        return math.log(((counts[1][g] + 1) / n[1]) / ((counts[0][g] + 1) / n[0]))

    def vector(h):
        length = math.sqrt(sum(ratio(g) ** 2 for g in h))
        return {g: ratio(g) / length for g in h} if length else {}

    vectors = [vector(h) for h in held]

    def margin(weights, v):
        return sum(x * weights.get(g, 0.0) for g, x in v.items())

    def gathered(slopes):
        total = Counter()
        for slope, v in zip(slopes, vectors):
            for g, x in v.items():
                total[g] += slope * x
        return total

    share = labels.count(1) / len(labels)
    balance = [0.5 / share if label else 0.5 / (1 - share) for label in labels]
    direction = [1 / math.sqrt(len(rows))] * len(rows)
    for _ in range(6):
        weights, total = gathered(direction), sum(direction)
        direction = [margin(weights, v) + total for v in vectors]
        largest = math.sqrt(sum(x * x for x in direction))
        direction = [x / largest for x in direction]
    step = 1 / (0.3 * largest * max(balance) + toxicity.PENALTY)
    weights, bias, lead, lead_bias = {}, 0.0, {}, 0.0
    for turn in range(1, toxicity.ROUNDS + 1):
        slopes = [b * (1 / (1 + math.exp(-(margin(lead, v) + lead_bias))) - label) for b, v, label in zip(balance, vectors, labels)]
        pull = gathered(slopes)
        after = {g: lead.get(g, 0.0) - step * (pull[g] + toxicity.PENALTY * lead.get(g, 0.0)) for g in pull.keys() | lead.keys()}
        after_bias = lead_bias - step * sum(slopes)
        push = (turn - 1) / (turn + 2)
        lead = {g: x + push * (x - weights.get(g, 0.0)) for g, x in after.items()}
        lead_bias = after_bias + push * (after_bias - bias)
        weights, bias = after, after_bias
    return lambda text: 1 / (1 + math.exp(-(bias + margin(weights, vector(grams(text))))))


def test_toxicity_equals_plain_version(spark, documents):
    rng = random.Random(8)
    parts = ["re", "An", "th", "on", "É", "le", "x", "ß"]

    def made(toxic):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 25))]
        return rng.choice([" ", "\n", "  "]).join(words + ["zwurg"] * (toxic and rng.random() < 0.8))

    texts = [made(i % 3 == 0) for i in range(200)] + ["", None, " \t", "a"]
    docs = documents(texts)
    labels = [int(i % 3 == 0) for i in range(60)]
    model = toxicity.fit(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    plain = plain_toxicity(texts[:60], labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == 204 and max(got.values()) > 0.6 > 0.4 > min(got.values())
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain(text), abs=2e-4)


# ------------------------------------------------------------------ language


def counted(text):
    """Hashed runs of 1 to 3 characters of the letters in lower case, anything else being one blank; blanks stand around."""
    total = Counter()
    if not text:
        return total
    points = [32]
    for c in text.lower():
        point = ord(c) if c.isalpha() else 32
        if point != 32 or points[-1] != 32:
            points.append(point)
    if points[-1] != 32 or len(points) == 1:
        points += [32] if points[-1] != 32 else []
    shift = 65 - language.BUCKETS.bit_length()
    for n in (1, 2, 3):
        for i in range(1 if n == 1 else 0, len(points) - n + 1):
            total[hashed(points[i:i + n]) >> shift] += 1
    return total


def scaled(vector):
    length = math.sqrt(sum(x * x for x in vector.values()))
    return {g: x / length for g, x in vector.items()} if length else {}


def dot(a, b):
    return sum(x * b.get(g, 0.0) for g, x in a.items())


def summed(vectors):
    total = Counter()
    for v in vectors:
        for g, x in v.items():
            total[g] += x
    return total


def plain_language(rows):
    """The centroids of labelled (text, lang) rows, as (lang, vector), and what weighs and scales a text."""
    seen = Counter(g for text, _ in rows for g in counted(text))
    idf = lambda g: math.log((1 + len(rows)) / (1 + seen[g])) + 1
    vector = lambda text: scaled({g: math.sqrt(n) * idf(g) for g, n in counted(text).items()})
    found = []
    for lang in sorted({lang for _, lang in rows}):
        vectors = [vector(t) for t in sorted(t for t, own in rows if own == lang)]
        middle = scaled(summed(vectors))
        nearest, picked = [dot(v, middle) for v in vectors], []
        while len(picked) < min(language.CENTROIDS, len(vectors)):
            far = min(range(len(vectors)), key=lambda i: nearest[i])
            picked.append(far)
            nearest = [max(x, dot(v, vectors[far])) for x, v in zip(nearest, vectors)]
        centres = [vectors[i] for i in picked]
        for _ in range(language.ROUNDS):
            owners = [max(range(len(centres)), key=lambda c: dot(v, centres[c])) for v in vectors]
            centres = [scaled(summed(v for v, o in zip(vectors, owners) if o == c)) if c in owners else centre for c, centre in enumerate(centres)]
        found += [(lang, centre) for centre in centres]
    return found, vector


def test_language_equals_plain_version(spark, documents):
    rng = random.Random(9)
    sounds = {"xx": ["ka", "to", "ri", "mu"], "yy": ["schl", "ung", "Über", "bra"], "zz": ["ция", "ово", "при"]}

    def made(lang, n):
        return rng.choice([" ", ", ", " 7\n"]).join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    rows = sorted({(made(lang, rng.randint(2, 12)), lang) for lang in sounds for _ in range(14)})
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    texts = [made(rng.choice(list(sounds)), rng.randint(1, 15)) for _ in range(200)] + ["", None, "12 !", "a", " a ", "αβγ"]
    got = {r.doc_id: r for r in language.identify(documents(texts), model).collect()}
    centres, vector = plain_language(rows)
    assert len(centres) == len(model.names)
    for i, text in enumerate(texts):
        if not text or not any(map(str.isalpha, text)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cosines = [(dot(vector(text), c), lang) for lang, c in centres]
        best = max(cosines)[0]
        assert got[i].score == pytest.approx(min(1.0, max(0.0, best)), abs=1e-4)
        assert got[i].lang_pred in {lang for x, lang in cosines if x > best - 1e-4}
