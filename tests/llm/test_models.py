import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from checks import DATA

from cortexa.llm import brown_lm, language_id, packing, queries, toxicity
from cortexa.llm.common import documents

ODD = [(1, None), (2, ""), (3, "12 34 --"), (None, "the and of"), (4, "the and of"), (4, "the and of"), (5, "the thing " * 20_000)]


def test_language_model_matches_brute_force(spark, docs_of):
    rng = random.Random(1)
    pairs = [*ODD, *((k, " ".join(f"W{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(0, 50)))) for k in range(10, 90))]
    words = [[w.decode() for w in (t or "").encode().lower().split()] for _, t in pairs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in pairs]
    counts = Counter(w for x, h in zip(words, held, strict=True) if not h for w in [*x, None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(i), h, len(x) + 1, sum(counts[w] > 0 for w in [*x, None]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*x, None]), 6)) for (i, _), x, h in zip(pairs, words, held, strict=True))
    for held_words in (1000, 12):  # with and without words that meet their counts in the join
        got = brown_lm.lm_scores(docs_of(pairs), clustered=10, classes=4, held_words=held_words).collect()
        assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score <= 1e-9 for r in got)
    model, _ = brown_lm.train(docs_of([p for p, h in zip(pairs, held, strict=True) if not h]), clustered=10, classes=4, held_words=1000)
    by_text = {}
    for x in words:  # the model's own probabilities, word by word
        total, before = 0.0, model.log_moves.shape[0] - 1
        for w in x:
            item = model.words.get(w.encode(), len(model.words) + brown_lm.shape(w.encode()))
            c = model.known[item]
            total += model.log_moves[before, c] + math.log10(counts[w] + 1) - model.log_sizes[c]
            before = c
        by_text[" ".join(x)] = total + model.log_moves[before, -1]
    scores = {x: round(s, 6) for x, s in by_text.items()}
    got = brown_lm.lm_scores(docs_of(pairs), clustered=10, classes=4, held_words=1000).join(docs_of(pairs).select("doc_id", "text"), "doc_id").collect()
    assert all(round(r.score, 6) == scores[" ".join(w.decode() for w in (r.text or "").encode().lower().split())] for r in got if r.doc_id != 4)


def test_emissions_of_a_class_sum_to_one_with_one_unseen_word(docs_of):
    model, counts = brown_lm.train(docs_of([(k, f"a{k % 7} b{k % 3} c") for k in range(60)]), clustered=4, classes=3, held_words=100)
    total = np.zeros(4)
    for r in counts.collect():
        total[model.known[model.words[bytes(r.word)]]] += r.n + 1
    sizes = 10**model.log_sizes[:3]
    assert np.allclose((total[:3] + 1) / sizes, 1)
    assert np.allclose((10**model.log_moves).sum(axis=1), 1)


def test_exchange_ends_when_no_move_makes_the_text_likelier():
    def likelihood(counts, own):
        member = np.eye(own.max() + 1)[own]
        table = member.T @ counts @ member
        part = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return part(table) - part(table.sum(axis=0)) - part(table.sum(axis=1))

    rng = np.random.default_rng(4)
    for _ in range(20):
        counts = rng.poisson(rng.gamma(0.4, 8, (14, 14))).astype(float)
        counts[rng.integers(14)] *= 30
        np.fill_diagonal(counts, counts.diagonal() * rng.integers(1, 40))  # words that often stand next to themselves
        own = brown_lm.exchange(counts, 3)
        best = likelihood(counts, own)
        for w in range(13):
            for c in range(3):
                moved = own.copy()
                moved[w] = c
                assert moved.max() < 3 or likelihood(counts, moved) <= best + 1e-6


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    counts = np.zeros((21, 21))
    kind = np.arange(20) % 2
    for _ in range(20_000):  # words of one kind follow those of the other
        a = rng.integers(20)
        counts[a, rng.choice(np.nonzero(kind != kind[a])[0])] += 1
    found = brown_lm.exchange(counts, 2)
    assert found[20] == 2
    assert len(set(zip(kind.tolist(), found[:20].tolist(), strict=True))) == 2


def test_rarer_words_take_the_class_of_largest_gain(docs_of):
    rng = random.Random(3)
    slot = lambda often, seldom: f"{often}{rng.randrange(3)}" if rng.random() < 0.8 else f"{seldom}{chr(97 + rng.randrange(20))}"
    line = lambda: " ".join(x for _ in range(12) for x in (slot("f", "rare"), slot("g", "seld")))
    model, counts = brown_lm.train(docs_of([(k, line()) for k in range(300)]), clustered=6, classes=3, held_words=3)
    of = {r.word.decode(): r["class"] for r in counts.collect()}
    # Of one shape, so by spelling all would be in one class.
    assert len({of[w] for w in of if w.startswith("rare")}) == len({of[w] for w in of if w.startswith("seld")}) == 1
    assert of["rarea"] == of["f0"] != of["g0"] == of["selda"] and len(of) == 46
    assert np.allclose((10**model.log_moves).sum(axis=1), 1)


def test_best_classes_are_those_of_the_likelihood():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 4, (13, 13)).astype(float)
    own = np.append(np.arange(12) % 4, 4)

    def likelihood(own):
        member = np.eye(5)[own]
        t = member.T @ counts @ member
        return brown_lm._xlogx(t).sum() - brown_lm._xlogx(t.sum(axis=0)).sum() - brown_lm._xlogx(t.sum(axis=1)).sum()

    member = np.eye(5)[own]
    for w in range(12):
        near = np.zeros(11)
        for v in range(13):
            if v == w:
                near[10] = counts[w, w]
            else:
                near[own[v]] += counts[w, v]
                near[5 + own[v]] += counts[v, w]
        key = np.nonzero(near)[0]
        got = brown_lm.best_classes(member.T @ counts @ member, own[[w]], np.zeros(len(key), np.int64), key, near[key])[0]
        assert got == max(range(4), key=lambda b: likelihood(np.where(np.arange(13) == w, b, own)))


def test_language_model_without_training_rows(docs_of):
    held = [(k, "some words here") for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2]
    got = brown_lm.lm_scores(docs_of(held), clustered=5, classes=2).collect()
    assert len(got) == len(held)
    assert {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}
    assert brown_lm.lm_scores(docs_of([]), clustered=5, classes=2).collect() == []


def test_language_model_query_beats_its_base(spark):
    got = queries.QUERIES["op3_brown_lm"](spark, DATA).toPandas()
    assert len(got) == documents(spark, DATA).count()
    assert got[got.held_out].score.sum() > got[got.held_out].base_score.sum()


def test_language_id_held_out_accuracy(spark):
    got = queries.QUERIES["op4_language_id"](spark, DATA)
    rows = got.join(documents(spark, DATA).select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents(spark, DATA).count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_odd_rows(docs_of):
    rng = random.Random(1)
    vocab = {"aa": ["kuuma", "talo", "puu"], "bb": ["shore", "think", "wash"]}
    pairs = [(k, " ".join(rng.choice(vocab[x]) for _ in range(8)), x) for k in range(100) for x in [rng.choice(["aa", "bb"])]]
    pairs += [(201, None, "aa"), (202, "", "bb"), (203, "12 !! 34_", "aa"), (204, "kuumatalo", None), (None, "Washing SHORES", "bb"), (205, "talo " * 30_000, "aa")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(docs_of(pairs)).collect()}
    assert [got[k][0] for k in (201, 202, 203, 204, None, 205)] == ["und", "und", "und", "aa", "bb", "aa"]
    assert got[201][1] == got[203][1] == 0
    assert {r.lang_pred for r in language_id.language_id(docs_of([(1, "text", None)])).collect()} == {"und"}
    assert language_id.language_id(docs_of([])).collect() == []


def test_unseen_words_fall_back_to_shorter_grams():
    model = language_id.Model(["a", "b"], {"abc": 0}, np.array([[-1.0, -5.0]]), {"xyz": 0, "q": 1}, np.array([[-2.0, -3.0], [-7.0, -4.0]]))
    scorer = language_id.Scorer(model)
    assert scorer.of(["abc", "xyz", "q", "abc"]).tolist() == [[-1, -5], [-2, -3], [-7, -4], [-1, -5]]
    assert scorer.of(["xyzq"]).tolist() == [[-4.5, -3.5]]
    assert scorer.of(["m"]).tolist() == [[0, 0]]


def language_by_brute_force(pairs):
    """doc_id: lang_pred, score by the whole tables of words and n-grams."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in pairs]
    words, grams = {}, {}
    for (_, t, lang), h in zip(pairs, held, strict=True):
        if not h and lang:
            for w in language_id.words_of((t or "").encode()):
                words.setdefault(w, Counter())[lang] += 1
                for size in range(1, 5):
                    for g in language_id.grams_of(w, size):
                        grams.setdefault(g, Counter())[lang] += 1
    langs = sorted({x for c in words.values() for x in c})
    total = {x: sum(c[x] for c in words.values()) for x in langs}
    of_size = {(k, x): sum(c[x] for g, c in grams.items() if len(g) == k) for k in range(1, 5) for x in langs}

    def score(w, x):
        if w in words:
            return math.log((words[w][x] + 0.5) / (total[x] + 0.5 * len(words)))
        line = f" {w} "
        best = [next((line[i:e] for e in range(min(i + 4, len(line)), i, -1) if line[i:e] in grams), None) for i in range(len(line))]
        found = [math.log((grams[g][x] + 0.5) / (of_size[len(g), x] + 0.5 * len(grams))) for g in best if g]
        return sum(found) / max(1, len(found))

    out = {}
    for i, t, _ in pairs:
        x = language_id.words_of((t or "").encode())
        sums = [sum(score(w, lang) for w in x) for lang in langs]
        top = max(range(len(langs)), key=lambda k: (sums[k], -k))
        out[i] = (langs[top], round(1 / sum(math.exp((s - sums[top]) / math.sqrt(len(x))) for s in sums), 6)) if x else ("und", 0)
    return out


@pytest.mark.parametrize("held_words, held_grams", [(1, 1), (40, 30), (10_000, 10_000)])
def test_every_trained_word_and_gram_is_known_whatever_tasks_hold(docs_of, held_words, held_grams):
    rng = random.Random(5)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
    vocab = {x: [make(letters) for _ in range(120)] for x, letters in (("aa", "abcdefg"), ("bb", "cdefghi"), ("cc", "efghijx"))}
    pairs = [(k, " ".join(rng.choice(vocab[x]) if rng.random() < 0.8 else make("abcdefghijxyz") for _ in range(rng.randrange(0, 9))), x) for k in range(90) for x in [rng.choice(list(vocab))]]
    pairs += [(900, None, "aa"), (901, "zzyx hij", None), (902, "qqq", None)]
    got = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language_id.language_id(docs_of(pairs), held_words=held_words, held_grams=held_grams).collect()}
    assert got == language_by_brute_force(pairs)


def toxic_table(n, seed=0):
    rng = random.Random(seed)
    common, bad = [f"w{k}" for k in range(300)], ["scum", "vile", "awful"]
    rows, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.15
        text = rng.choices(common, k=40) + (rng.choices(bad, k=3) if toxic else [])
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
        if rng.random() < 0.5:
            labels.append((k, 1, int(toxic), "x"))
        rows[-1] += (toxic,)
    return rows, labels


def test_toxicity_on_planted_rows(spark, docs_of):
    rows, labels = toxic_table(1500)
    extra = [(5001, None), (5002, ""), (None, "scum vile awful"), (5003, "w1 " * 50_000)]
    labels += [(5001, 1, 0, "x"), (None, 1, 1, "x"), (7, None, None, "x")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs_of([*(r[:2] for r in rows), *extra]), table).collect()}
    assert len(got) == len(rows) + len(extra)
    truth = {k: t for k, _, t in rows}
    held = [k for k in truth if got[k].held_out]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in truth)
    caught = sum(got[k].predicted for k in held if truth[k]) / sum(truth[k] for k in held)
    wrong = sum(got[k].predicted for k in held if not truth[k]) / sum(not truth[k] for k in held)
    assert caught > 0.95 and wrong < 0.03
    assert got[5001].predicted == got[5002].predicted == got[5003].predicted == 0 and got[None].predicted == 1
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())


def toxicity_by_brute_force(rows, labels):
    """Scores document by document and term by term."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    marks = {}
    for i, toxic in labels:
        if i is not None and toxic is not None and not held(i):
            marks[i] = max(toxic, marks.get(i, 0))
    bag = lambda t: {x for w in re.findall("[a-z0-9\u0080-\U0010ffff]+", (t or "").lower()) for x in ((w,), *([(w.encode()[:5], "start")] if len(w.encode()) > 5 else []))}
    train = [(i, bag(t)) for i, t in rows if i is not None and not held(i)]
    pos, every = [b for i, b in train if marks.get(i) == 1], [b for _, b in train]
    prior = sum(marks.values()) / len(marks)
    stands = []
    for x in sorted(set().union(*pos), key=repr):
        p, u = sum(x in b for b in pos), sum(x in b for b in every)
        odds = math.log((p + 0.5) / (len(pos) + 1)) - math.log((u + 0.5) / (len(every) + 1))
        if p > 1 and abs(odds) / math.sqrt(1 / (p + 0.5) + 1 / (u + 0.5)) >= 4:
            stands.append(x)
    weight, bias, m, v = dict.fromkeys(stands, 0.0), 0.0, Counter(), Counter()
    score = lambda b: bias + sum(w for x, w in weight.items() if x in b)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for t in range(1, 251):
        softplus = lambda z: math.log1p(math.exp(z))
        rest = sum(softplus(score(b)) for b in every) / len(every) - prior * sum(softplus(score(b)) for b in pos) / len(pos)
        grad = Counter()
        for group, factor in ((pos, prior / len(pos)), (every, 1 / len(every))):
            for b in group:
                s = sigmoid(score(b))
                if rest >= 0:  # positives as toxic, then the corrected risk of unlabelled text as clean
                    d = factor * ((s - 1) - s) if group is pos else factor * s
                else:
                    d = factor * s if group is pos else -factor * s
                grad[None] += d
                for x in b & weight.keys():
                    grad[x] += d
        for x in [*stands, None]:
            g = grad[x] + (3e-4 * prior * weight[x] if x is not None else 0)
            m[x], v[x] = 0.9 * m[x] + 0.1 * g, 0.999 * v[x] + 0.001 * g * g
            step = 0.1 * (m[x] / (1 - 0.9**t)) / (math.sqrt(v[x] / (1 - 0.999**t)) + 1e-8)
            if x is None:
                bias -= step
            else:
                weight[x] -= step
    return sorted((repr(i), held(i), round(sigmoid(score(bag(t))), 6)) for i, t in rows), len(stands)


def test_toxicity_matches_brute_force(spark, docs_of):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(220):
        toxic = rng.random() < 0.3
        words = rng.choices(["plain", "Ordinary", "texts", "ordinariness", "é1"], k=8) + (rng.choices(["scum", "vile", "vileness"], k=4) if toxic and rng.random() < 0.9 else [])
        rows.append((k, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((k, int(toxic)))
    rows += [(3, "vile scum again"), (3, "vile scum again"), (None, "scum"), (900, None), (901, ""), (902, "scum vile " * 5000)]
    labels += [(3, 1), (3, 0), (3, 1), (None, 1), (5, None), (7777, 1)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    want, terms = toxicity_by_brute_force(rows, labels)
    got = toxicity.toxicity(docs_of(rows), table).collect()
    assert terms > 2
    assert sorted((repr(r.doc_id), r.held_out, round(r.score, 6)) for r in got) == want
    assert all(r.predicted == int(r.score >= 0.5) for r in got)


def test_drawn_rows_have_a_bound(docs_of):
    docs = docs_of([(k % 7, f"word{k}") for k in range(50)]).select("doc_id", "text")
    names = [f"word{k}".encode() for k in range(50)]
    assert len(toxicity._sets(docs, 20, names)) == 20
    assert [x.tolist() for x in toxicity._sets(docs.repartition(5), 20, names)] == [x.tolist() for x in toxicity._sets(docs, 20, names)]
    assert toxicity._within([(1, 5), (2, 8), (3, 4), (4, 1)], 10) == [1, 3, 4]


def test_words_that_share_a_hash_are_told_apart(docs_of):
    import xxhash

    seen, pair = {}, None
    for k in range(200_000):  # two words whose hashes are alike in 24 bits
        word = b"v%d" % k
        if (other := seen.setdefault(xxhash.xxh32_intdigest(word) & 0xFFFFFF, word)) != word:
            pair = other.decode(), word.decode()
            break
    rows = [(k, pair[k % 2] + " plain") for k in range(40)]
    names = [pair[0].encode(), b"plain"]
    assert toxicity._counted(docs_of(rows), names).tolist() == [20, 40]
    model = toxicity.Model({pair[0].encode(): 9.0}, -5.0)
    assert {r.doc_id % 2: r.predicted for r in toxicity.score(docs_of(rows), model).collect()} == {0: 1, 1: 0}


def test_toxicity_without_labels(spark, docs_of):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.toxicity(docs_of([(1, "a"), (2, None)]), empty).collect()] == [0, 0]
    assert toxicity.toxicity(docs_of([]), empty).collect() == []


def test_negative_risk_is_corrected():
    rng = np.random.default_rng(0)
    sets = [np.unique(np.append(rng.integers(10, 40, 8), [1] if k < 60 or 60 <= k < 90 else [])).astype(np.int32) for k in range(400)]
    model = toxicity.fit([b"%d" % k for k in range(40)], sets, np.arange(400) < 60, prior=30 / 340, steps=200)
    assert model.weights[b"1"] > 1 and model.bias < 0
    assert model.bias + model.weights[b"1"] > 0


def naive_pack(lengths, capacities):
    """Opened and final sizes of best fit that looks at every bin, and at every waiting piece, for every piece."""
    bins, opened = [], []
    for i, n in enumerate(lengths):
        fits = [(c - f, -k) for k, (f, c) in enumerate(bins) if c - f >= n]
        if fits:
            k = -min(fits)[1]
            bins[k] = (bins[k][0] + n, bins[k][1])
            continue
        worth = []
        for c in capacities:
            held = n
            for other in lengths[i + 1 :]:
                held += other if held + other <= c else 0
            if c >= n:
                worth.append(((c + packing.FIXED_COST + c**2 / packing.ATTENTION_SPAN) / max(1, held), c))
        opened.append(min(worth)[1])
        bins.append((n, opened[-1]))
    return sorted(opened), sorted(next(c for c in capacities if c >= f) for f, _ in bins)


@pytest.mark.parametrize("seed", range(5))
def test_pack_is_best_fit(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randrange(0, 40) for _ in range(300)), reverse=True)
    bins, offsets, opened, sizes = packing.pack(lengths, (8, 16, 40))
    held = Counter()
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        assert o == held[b]
        held[b] += n
    assert all(held[b] <= sizes[b] <= opened[b] and all(c < held[b] for c in (8, 16, 40) if c < sizes[b]) for b in set(bins))
    # Which of equally full bins is taken does not matter: what is left over is the same.
    assert (sorted(opened), sorted(sizes)) == naive_pack(lengths, (8, 16, 40))
    assert packing.pack([3, 3, 0, 0], (8, 16))[0] == [0, 0, 0, 0]


@pytest.mark.parametrize("seed", range(4))
def test_permitted_lengths_are_chosen_jointly(seed):
    rng = random.Random(seed)
    lengths = sorted((int(min(9000, rng.lognormvariate(6, 1.2))) for _ in range(3000)), reverse=True)

    def whole(capacities):
        cut = sorted((min(capacities[-1], n - at) for n in lengths for at in range(0, max(1, n), capacities[-1])), reverse=True)
        _, _, opened, sizes = packing.pack(cut, capacities)
        return sum(map(packing.cost, sizes)), set(opened)

    joint, opened = whole(packing.CAPACITIES)
    assert opened == set(packing.CAPACITIES)
    assert joint < whole((4096,))[0]  # the only single length that cuts nothing more
    # What the choice itself is worth: against opening the shortest length that holds the piece, or always the longest.
    naive = packing.pack(sorted((min(4096, n - at) for n in lengths for at in range(0, max(1, n), 4096)), reverse=True), (4096,))
    held = Counter()
    for n, b in zip(sorted((min(4096, n - at) for n in lengths for at in range(0, max(1, n), 4096)), reverse=True), naive[0], strict=True):
        held[b] += n
    assert joint < sum(packing.cost(next(c for c in packing.CAPACITIES if c >= f)) for f in held.values())


def test_packing_covers_every_word_once(docs_of):
    rng = random.Random(4)
    pairs = [*ODD, *((100 + k, "w " * rng.randrange(0, 3000)) for k in range(60))]
    got = packing.best_fit(docs_of(pairs), shard_pieces=25).collect()
    spans = Counter()
    for r in got:
        spans[r.doc_id] += r.n_words
    want = Counter()
    for i, t in pairs:
        want[i] += len((t or "").split())
    assert spans == want
    assert {i for i, _ in pairs} == {r.doc_id for r in got}
    by_bin = {}
    for r in got:
        by_bin.setdefault(r.bin_id, []).append(r)
    for rows in by_bin.values():
        rows.sort(key=lambda r: (r.bin_offset, r.n_words))
        end = 0
        for r in rows:
            assert r.bin_offset == end
            end += r.n_words
        assert {r.bin_size for r in rows} == {next(c for c in packing.CAPACITIES if c >= end)}
    assert all(r.start_word == r.part * 4096 for r in got)
    assert packing.best_fit(docs_of([])).collect() == []


def test_packing_query_wastes_little(spark):
    got = queries.QUERIES["op9_best_fit_packing"](spark, DATA).toPandas()
    bins = got.groupby("bin_id").agg(n=("n_words", "sum"), size=("bin_size", "first"))
    assert bins.n.sum() >= 0.97 * bins["size"].sum()


def test_best_classes_of_many_words_are_those_of_each():
    rng = np.random.default_rng(5)
    k, many = 7, 300
    pair = np.unique(rng.integers(0, many * (2 * k + 1), 4_000))
    word, key, n = pair // (2 * k + 1), pair % (2 * k + 1), rng.integers(1, 6, len(pair))
    own = rng.integers(0, k - 1, many)
    table = rng.integers(0, 30, (k, k)).astype(float)
    for w, c, x in zip(word, key, n, strict=True):
        table[(own[w], c) if c < k else (c - k, own[w]) if c < 2 * k else (own[w], own[w])] += x
    got = brown_lm.best_classes(table, own, word, key, n)
    for w in range(many):
        mine = word == w
        assert got[w] == brown_lm.best_classes(table, own[[w]], np.zeros(mine.sum(), np.int64), key[mine], n[mine])[0]


@pytest.mark.parametrize("step", [3, 20, 10_000])
def test_rows_of_a_word_are_summed_across_batches(monkeypatch, step):
    monkeypatch.setattr(brown_lm, "CLASS_STEP", step)
    rng = random.Random(step)
    rows, want = [], Counter()
    for w in sorted({bytes(rng.choices(b"ab", k=rng.randint(0, 3))) for _ in range(30)}):
        for _ in range(rng.choice([1, 1, 2, 9])):
            keys = sorted(rng.sample(range(9), rng.randint(1, 5)))
            counts = [rng.randint(1, 4) for _ in keys]
            rows.append((w, keys, counts))
            want.update({(w, c): 0 for c in keys})
            for c, n in zip(keys, counts, strict=True):
                want[w, c] += n
    kinds = (pa.binary(), pa.list_(pa.int16()), pa.list_(pa.int32()))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 7]], kind) for i, kind in enumerate(kinds)], ["word", "keys", "counts"]) for at in range(0, len(rows), 7)]
    got = [((words[w], c), n) for words, word, key, counts in brown_lm.whole_words(iter(batches), 9) for w, c, n in zip(word.tolist(), key.tolist(), counts.tolist(), strict=True)]
    assert len(got) == len(want) and dict(got) == dict(want)
    assert list(brown_lm.whole_words(iter([]), 9)) == []


def test_steps_of_lists_are_whole_and_bounded(monkeypatch):
    monkeypatch.setattr(brown_lm, "STEP", 10)
    lists = [[1] * n for n in (0, 3, 25, 4, 4, 0, 9, 10, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int16()))], ["v"])
    parts = list(brown_lm.list_slices(batch, 0))
    assert [v for p in parts for v in p.column(0).to_pylist()] == lists
    assert all(p.num_rows == 1 or sum(len(v or []) + 1 for v in p.column(0).to_pylist()) <= 10 for p in parts)


def test_numbers_give_new_words_the_kind_of_their_shape():
    shapes = np.arange(100, 100 + brown_lm.SHAPES)
    numbers = brown_lm.Numbers({b"a": 0, b"b": 1}, np.array([7, 8]), shapes)
    line, size = numbers.line([b"b C9 a", b"", b"c9 d"], ends=True)
    assert line.tolist() == [-1, 1, 2, 0, -1, -1, 2, 3, -1] and size.tolist() == [3, 0, 2]
    assert numbers.names == [b"c9", b"d"]
    assert numbers.kinds.tolist() == [7, 8, shapes[brown_lm.shape(b"c9")], shapes[brown_lm.shape(b"d")]]
    assert numbers.line([], ends=False)[0].tolist() == []
