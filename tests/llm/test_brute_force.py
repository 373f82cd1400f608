"""Toxicity scores and license scans against slow, plain versions."""

import bisect
import math
import random
import re
from collections import Counter

import pytest

from graphlens.llm import license_scan, toxicity

# --- toxicity: features word by word, trees walked by hand, calibration interpolated --------------


def term_weight(word, terms):
    found = [terms[word]] if word in terms else []
    for k in (4, 5, 6):
        if len(word) > k and word[:k] + "-" in terms:
            found.append(terms[word[:k] + "-"])
    return max(found, default=0.0)


def bare(token):
    while token and not token[0].isalnum():
        token = token[1:]
    while token and not token[-1].isalnum():
        token = token[:-1]
    return token


def slow_features(text, terms):
    tokens = text.split()
    if not tokens:
        return [0.0] * 15
    seen = []
    for token in tokens:
        word = bare(token)
        low = word.lower()
        weight, hidden = (term_weight(low, terms) if low else 0.0), False
        odd = re.search(r"[^\W\d_][\d@$!*|#%&]+[^\W\d_]", token) is not None
        drawn = re.search(r"(.)\1\1", low) is not None
        if odd:
            plain = token.lower()
            for a, b in zip("013457@$!|", "oieastasil"):
                plain = plain.replace(a, b)
            if term_weight(bare(plain), terms) > weight:
                weight, hidden = term_weight(bare(plain), terms), True
        if drawn:
            plain = re.sub(r"(.)\1\1+", r"\1", low)
            if term_weight(plain, terms) > weight:
                weight, hidden = term_weight(plain, terms), True
        shout = len(word) > 1 and word.isupper()
        seen.append((weight, low in toxicity.SECOND_PERSON, shout, odd, drawn, hidden))
    n = len(seen)
    hits = [i for i in range(n) if seen[i][0] > 0]
    you = [i for i in range(n) if seen[i][1]]
    near = sum(any(abs(i - j) <= 4 for j in you) for i in hits) / len(hits) if hits and you else 0.0
    raw = text.encode()
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in raw) or 1
    marks = sum(33 <= c < 127 and not chr(c).isalnum() for c in raw)
    return [
        math.log1p(len(hits)), len(hits) / n, sum(seen[i][0] for i in hits) / n, max(s[0] for s in seen), math.log1p(len({seen[i] for i in hits})),
        float(sum(s[5] for s in seen)), near, len(you) / n, sum(65 <= c <= 90 for c in raw) / letters, sum(s[2] for s in seen) / n, marks / len(raw),
        text.count("!") / n, sum(s[3] for s in seen) / n, sum(s[4] for s in seen) / n, math.log1p(n),
    ]


def leaf(node, vector):
    while node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        node = node.leftChild() if vector[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def slow_score(model, vector):
    margin = sum(w * leaf(t._call_java("rootNode"), vector) for t, w in zip(model.trees.trees, model.trees.treeWeights))
    p = 1 / (1 + math.exp(-2 * margin))
    xs, ys = list(model.calibration.boundaries), list(model.calibration.predictions)
    if p <= xs[0] or p >= xs[-1]:
        return ys[0] if p <= xs[0] else ys[-1]
    k = bisect.bisect_left(xs, p)
    return ys[k] if xs[k] == p else ys[k - 1] + (ys[k] - ys[k - 1]) * (p - xs[k - 1]) / (xs[k] - xs[k - 1])


def test_toxicity_scores_equal_a_plain_walk(spark):
    rng = random.Random(12)
    good, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}lm" for i in range(120)], ["grubnak", "snorvil", "plefted"]

    def spoil(word):
        return rng.choice([word, word.upper(), word.replace("o", "0"), word.replace("a", "@"), word + word[-1] * 3, word + "!!", word[:2] + "*" + word[2:]])

    docs, labels = [], []
    for i in range(420):
        toxic = i % 3 == 0
        words = [spoil(w) if rng.random() < 0.1 else w for w in rng.choices(good, k=rng.randint(5, 60))]
        if toxic or rng.random() < 0.1:
            for _ in range(1 + toxic * 2):
                words.insert(rng.randrange(len(words)), rng.choice(["you", "your", "du"]))
                words.insert(rng.randrange(len(words)), spoil(rng.choice(bad)))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic != (rng.random() < 0.15))))  # labels that contradict give scores between 0 and 1
    docs += [(1000, ""), (1001, None), (1002, "you " * 30_000 + "grubnak"), (1003, "!!! ___ 12"), (1004, "Ünïçödé SNORVIL\tdu\n")]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(frame, table)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score_documents(frame, table).collect()}
    assert model.lexicon and model.calibration is not None and len({s for s, _ in got.values()}) > 2
    lexicon = toxicity.Lexicon(model.lexicon)
    assert set(got) == {i for i, _ in docs}
    for i, text in docs[:60] + docs[-5:]:
        vector = slow_features(text or "", model.lexicon)
        assert vector == pytest.approx(toxicity.features(text or "", lexicon))
        score = min(1.0, max(0.0, slow_score(model, vector)))
        assert got[i] == (pytest.approx(score), int(score >= 0.7))


# --- licenses: every stretch, aligned by plain recursion -----------------------------------------


def longest_rise(values):
    """Positions of the longest rise; it ends in the smallest of the possible last values, and so on backwards."""
    if not values:
        return []
    length = []
    for i, v in enumerate(values):
        length.append(1 + max((length[j] for j in range(i) if values[j] < v), default=0))
    at = min((i for i in range(len(values)) if length[i] == max(length)), key=lambda i: values[i])
    out = [at]
    while length[at] > 1:
        at = min((j for j in range(at) if length[j] == length[at] - 1), key=lambda j: values[j])
        out.append(at)
    return out[::-1]


def slow_align(a, b, i=0, j=0):
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(i, j)] + slow_align(a[1:], b[1:], i + 1, j + 1)
    if a[-1] == b[-1]:
        return slow_align(a[:-1], b[:-1], i, j) + [(i + len(a) - 1, j + len(b) - 1)]
    unique = [(p, b.index(w)) for p, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    chosen = [unique[k] for k in longest_rise([q for _, q in unique])]
    if not chosen:
        return []
    out, p0, q0 = [], 0, 0
    for p, q in chosen:
        out += slow_align(a[p0:p], b[q0:q], i + p0, j + q0) + [(i + p, j + q)]
        p0, q0 = p + 1, q + 1
    return out + slow_align(a[p0:], b[q0:], i + p0, j + q0)


def slow_scan(text, templates, coverage):
    out = []
    for name, template in templates.items():
        at = [i for i, w in enumerate(text) if w in template]
        found, b, best = [], 0, None
        while b < len(at):
            if best and (at[b] >= best[2] or best[0] == 1):
                found.append(best)
                b, best = next((k for k in range(b, len(at)) if at[k] >= best[2]), len(at)), None
                continue
            e, held = b, Counter()
            while e < len(at) and at[e] < at[b] + 2 * len(template) and sum(min(n, template.count(w)) for w, n in held.items()) < len(template):
                held[text[at[e]]] += 1
                e += 1
            pairs = slow_align(text[at[b] : at[e - 1] + 1], template)
            share = len(pairs) / len(template)
            if share >= coverage - 1e-12 and (best is None or share > best[0]):
                best = (share, at[b] + pairs[0][0], at[b] + pairs[-1][0] + 1)
            b += 1
        found += [best] if best else []
        if found:
            top = max(f[0] for f in found)
            out.append((name, *next(f for f in found if f[0] == top), len(found)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_license_scan_equals_every_stretch_aligned(spark, seed):
    rng = random.Random(seed)
    letters = "abcdefghij"
    templates = {"T1": " ".join(rng.choices(letters, k=9)), "T2": " ".join(rng.choices(letters, k=6)), "T3": "zz " + " ".join(rng.choices(letters[:4], k=5)), "T4": "qq"}
    docs = [(0, None), (1, ""), (2, "x " * 50_000 + templates["T1"] + " y" * 50_000)]
    for i in range(3, 60):
        words = rng.choices(letters + "xyz", k=rng.randint(0, 25))
        for _ in range(rng.randint(0, 3)):
            notice = rng.choice(list(templates.values())).split()
            for _ in range(rng.randint(0, 2)):
                k = rng.randint(0, len(notice))
                notice[k : k + rng.randint(0, 1)] = rng.choices(letters + "x", k=rng.randint(0, 2))
            k = rng.randint(0, len(words))
            words[k:k] = notice or ["a"]
        docs.append((i, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in license_scan.license_scan(frame, templates, 0.7).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["coverage"], r["first_word"], r["end_word"], r["notices"]))
    cut = {name: t.split() for name, t in templates.items()}
    for i, text in docs:
        want = slow_scan((text or "").split(), cut, 0.7) or [(None, 0.0, None, None, 0)]
        assert sorted(got[i], key=str) == sorted(want, key=str), (i, text)
