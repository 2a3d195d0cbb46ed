"""Kernels of the training-data operators against brute force."""

import random

import numpy as np
import pytest

from delvegraph.llm import embed_dedup, language_id, lm_score, minhash_dedup, suffix_dedup, textkit, token_count
from delvegraph.llm.decontaminate import ItemAutomaton, cut_words, words
from delvegraph.llm.encoding import WordEncoder, default_path

RNG = random.Random(4)
ALPHABET = "aAbÉéßſµ²½9 '’\t\n\x85\xa0\x1c.,!sStTreveldmLL''-_İǅɏΣσé漢€"


@pytest.fixture(scope="module")
def enc():
    return WordEncoder(default_path(), memory=50)


def test_encoder_is_the_library(enc):
    for _ in range(3000):
        s = "".join(RNG.choice(ALPHABET) for _ in range(RNG.randint(0, 14))) + RNG.choice(["", "<|endoftext|>", "'s", " "])
        assert enc.encode([s])[0] == enc.whole(s), repr(s)
    assert enc.encode([None, ""]) == [b"", b""]


PIECES = ["word", " ", "\n", "é", "é", " ́x", "漢字", "<|endoftext|>", "a" * 40, "'ll", "12", "…", "한글", "\x1c"]


def test_chunked_counts_are_whole_counts(enc):
    whole = lambda s: len(enc.tokenizer.encode(s, add_special_tokens=False).ids)
    for k in range(300):
        some = PIECES[:2] + ["Ünd", "x.", "'s"] if k % 3 == 0 else PIECES
        s = "".join(RNG.choice(some) for _ in range(RNG.randint(0, 120)))
        assert token_count.count_chunked(enc, s, 40, 6) == whole(s), repr(s)
    assert token_count.count_chunked(enc, "x" * 500, 40, 6) == whole("x" * 500)
    s = "plain words here " * 300
    assert token_count.count_chunked(enc, s, 64, 16) == whole(s)


def test_huge_texts_are_counted_in_segments(spark, enc):
    rows = [(k, "".join(RNG.choice(PIECES[:6] if k % 2 else ["some", " ", "words.", " "]) for _ in range(RNG.randint(0, 900)))) for k in range(12)]
    rows += [(12, "x" * 3000), (13, None), (14, " " * 2000), (14, "one two " * 500), (14, "one two " * 500)]
    want = sorted((k, len(enc.tokenizer.encode(t or "", add_special_tokens=False).ids)) for k, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens) for r in token_count.count_tokens(df, chunk=64, overlap=16, segment=500).collect())
    assert got == want


def test_word_and_shingle_hashes():
    texts = [b"", b"  ", b"One two\tTHREE four five", b"one TWO three four five", b"one two"]
    h, first = textkit.word_hashes(texts)
    assert np.diff(first).tolist() == [0, 0, 5, 5, 2]
    assert h[:5].tolist() == h[5:10].tolist() and len(set(h[:5].tolist())) == 5
    s, at = textkit.shingle_hashes(texts, 4)
    assert np.diff(at).tolist() == [0, 0, 2, 2, 1]
    morse = "a"
    while len(morse) < 4096:  # equal under every polynomial modulo a power of two
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    h, _ = textkit.word_hashes([morse.encode(), other.encode(), morse.encode()])
    assert h[0] == h[2] != h[1]
    many = [bytes(RNG.choice(b"abc") for _ in range(RNG.randint(1, 200))) for _ in range(3000)]
    h, _ = textkit.word_hashes([b" ".join(many)])
    assert len(set(h.tolist())) == len(set(many)) and len({(a, b) for a, b in zip(many, h.tolist(), strict=True)}) == len(set(many))


def test_samples_are_min_wise():
    rng = np.random.default_rng(9)
    alike = []
    for _ in range(60):  # sets of similarity 0.8
        u = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
        keys, _, _ = minhash_dedup.signatures([np.unique(u[:900]), np.unique(u[100:])])
        alike.append((keys[0] == keys[1]).mean())
    assert abs(np.mean(alike) - 0.8**minhash_dedup.ROWS) < 0.02
    # estimates of pairs at 0.8 below the cut: 96 samples, a fifth of which differ and flip two bits each
    d = rng.binomial(96, 0.2, 200_000)
    low = 0
    for k in np.unique(d):
        n = int((d == k).sum())
        bits = rng.integers(0, 256, (n, 2 * k))
        odd = (np.bincount((np.arange(n)[:, None] * 256 + bits).ravel(), minlength=n * 256).reshape(n, 256) & 1).sum(axis=1)
        low += int((minhash_dedup.estimate(odd) < minhash_dedup.LEAST_ESTIMATE).sum())
    assert low == 0


def test_automaton_equals_window_search():
    vocab = [w.encode() for w in "a b c d".split()]
    for _ in range(200):
        items = [(str(i), [RNG.choice(vocab) for _ in range(RNG.randint(0, 7))]) for i in range(RNG.randint(0, 5))]
        doc = [RNG.choice([*vocab, b"z"]) for _ in range(RNG.randint(0, 40))]
        hit, seen = set(), set()
        for name, item in items:
            wins = {tuple(item[i : i + 4]) for i in range(len(item) - 3)} if len(item) >= 4 else ({tuple(item)} if item else set())
            for w in wins:
                for i in range(len(doc) - len(w) + 1):
                    if tuple(doc[i : i + len(w)]) == w:
                        hit.update(range(i, i + len(w)))
                        seen.add(name)
        a = ItemAutomaton(items, 4)
        runs, found = a.hits(doc)
        assert {p for x, y in runs for p in range(x, y)} == hit and {a.names[k] for k in found} == seen
        assert all(runs[i][1] < runs[i + 1][0] for i in range(len(runs) - 1))


def test_nested_short_items_stay_small():
    items = [(str(i), [b"w"] * (1 + i % 12)) for i in range(3000)]
    a = ItemAutomaton(items, 13)
    runs, found = a.hits([b"w"] * 5 + [b"x"] + [b"w"] * 20)
    assert runs == [(0, 5), (6, 26)] and len(found) == 3000
    assert len(a.link) == 13 and sum(len(k) for _, k in a.whole.values()) == 3000


def test_cut_words_keeps_the_rest():
    t = "Äb, one TWO; three é"
    assert words(t) == ["Äb".encode(), b"one", b"two", b"three", "é".encode()]
    assert cut_words(t, [(1, 3)]) == "Äb, ; three é"


def brute_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        out.append(gone)
    return out


def test_blind_trie_orders_and_groups():
    strings = [bytes(RNG.choice(b"ab") for _ in range(6)) for _ in range(80)]
    trie = suffix_dedup.BlindTrie(6)
    for i, s in enumerate(strings):
        trie.insert(s, i)
    got = [sorted(x) for x in trie.leaves()]
    assert [strings[x[0]] for x in got] == sorted(set(strings))
    assert all(len({strings[i] for i in x}) == 1 for x in got) and sum(map(len, got)) == 80


def test_multikey_quicksort_sorts_each_group():
    raw = bytes(RNG.choice(b"ab") for _ in range(400)) * 2 + bytes(RNG.choice(b"abc") for _ in range(300))
    word = np.array([int.from_bytes(raw[i : i + 8].ljust(8, b"\0"), "big") for i in range(len(raw))], np.uint64)
    at = np.array([RNG.randrange(len(raw) - 32) for _ in range(900)])
    group = np.array([RNG.randrange(5) for _ in at])
    index, cls = suffix_dedup.multikey_quicksort(word, at, group, 16)
    key = lambda i: (group[i], raw[at[i] : at[i] + 16])
    same = {}
    for i in range(len(at)):
        same.setdefault(key(i), []).append(i)
    want = [sorted(v) for k, v in sorted(same.items()) if len(v) > 1]
    got = [sorted(index[cls == c].tolist()) for c in range(cls.max() + 1)]
    assert got == want
    assert [len(x) for x in suffix_dedup.multikey_quicksort(word, at[:0], group[:0], 16)] == [0, 0]


def test_texts_longer_than_a_segment(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    base = "".join(RNG.choice("abcdef ") for _ in range(2000))
    texts = [base[:1500], base[700:] + base[:900], "x" * 1000]
    ids = np.arange(3)
    whole = suffix_dedup.blocks(ids, [t.encode() for t in texts], 100)
    covered = {(int(o["doc"]), s) for o in whole for s in range(int(o["start"]), int(o["start"]) + int(o["size"]) - 99)}
    assert covered == {(k, s) for k, t in enumerate(texts) for s in range(len(t) - 99)}


def test_deep_shallow_finds_equal_suffixes():
    raw = np.frombuffer(bytes(RNG.choice(b"ab") for _ in range(60)) * 4 + bytes(RNG.choice(b"abc") for _ in range(200)), np.uint8)
    at = np.arange(len(raw) - 50)
    index, cls = suffix_dedup.deep_shallow(raw, at, np.zeros(len(at), np.int64), 50)
    got = {}
    for i, c in zip(index.tolist(), cls.tolist(), strict=True):
        got.setdefault(c, []).append(i)
    want = {}
    for i in at.tolist():
        want.setdefault(raw[i : i + 50].tobytes(), []).append(i)
    assert sorted(sorted(x) for x in got.values()) == sorted(x for x in want.values() if len(x) > 1)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    other = np.concatenate([base[:1800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    _, sk, _ = minhash_dedup.signatures([np.unique(base), np.unique(other), np.unique(base)])
    z = int(minhash_dedup._ONES[sk[0] ^ sk[1]].sum())
    assert abs(minhash_dedup.estimate(np.array([z]))[0] - 1800 / 2200) < 0.2
    assert (sk[0] == sk[2]).all()


def test_unit_links_span_components():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 400 - 10 * i], rng.integers(0, 1 << 62, 10 * i).astype(np.uint64)])) for i in range(6)] + [np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))]
    _, sk, _ = minhash_dedup.signatures(sets)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])):
                parent[find(i)] = find(j)
    links = minhash_dedup.unit_links(list(range(len(sets))), [0] * len(sets), sk, sets, 80)
    mine = list(range(len(sets)))
    for a, b in links:
        x, y = mine[a], mine[b]
        mine = [min(x, y) if m in (x, y) else m for m in mine]
    group = lambda f: sorted(map(sorted, {k: [i for i in range(len(sets)) if f(i) == k] for k in {f(i) for i in range(len(sets))}}.values()))
    assert group(find) == group(lambda i: mine[i])


def test_hnsw_recall_on_random_and_clustered_vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 32))
    x[:300] = x[0] + 0.15 * rng.standard_normal((300, 32))
    x[900:1000] = x[800:900] + 0.2 * rng.standard_normal((100, 32)) / np.sqrt(32) * np.linalg.norm(x[800:900], axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embed_dedup.Hnsw(x, np.arange(len(x)))
    assert index.audit(0.9) >= embed_dedup.AUDIT_RECALL and not index.exact
    index = embed_dedup.Hnsw.unpacked(index.packed(), x)
    q = x.astype(np.float32)
    found = index.search(q, 0.9, index.width)
    each = [len(t & set(f.tolist()) - {i}) / len(t - {i}) for i, (t, f) in enumerate((set(t.tolist()), f) for t, f in zip(index.brute(q, 0.9), found, strict=True)) if len(t) > 1]
    assert len(each) > 400 and np.mean(each) >= 0.999 and np.mean([e > 0 for e in each]) >= 0.99


def test_a_graph_that_cannot_reach_its_recall_is_left_to_brute_force():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embed_dedup.Hnsw(x, np.arange(len(x)))
    index.layers[-1].adj[:] = -1  # nothing is reachable
    assert index.audit(0.9) == 1.0 and index.exact


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(5)
    em, tr, st = rng.standard_normal((4, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    p = np.zeros((4, 3))
    for y in itertools.product(range(3), repeat=4):
        w = np.exp(st[y[0]] + sum(em[i, y[i]] for i in range(4)) + sum(tr[y[i], y[i + 1]] for i in range(3)))
        for i in range(4):
            p[i, y[i]] += w
    p /= p.sum(axis=1, keepdims=True)
    both = np.concatenate([em, em[:2]])
    got = language_id.marginals(both, np.array([0, 4]), np.array([4, 2]), tr, st)
    assert np.allclose(got[:4], p)


def log_likelihood(em, tr, st, y):
    import itertools

    score = lambda z: st[z[0]] + sum(em[i, z[i]] for i in range(len(em))) + sum(tr[z[i], z[i + 1]] for i in range(len(em) - 1))
    return score(y) - np.log(sum(np.exp(score(z)) for z in itertools.product(range(len(st)), repeat=len(em))))


def test_expected_transitions_are_the_gradient():
    rng = np.random.default_rng(8)
    em, tr, st = rng.standard_normal((9, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    y = rng.integers(0, 3, 9)
    chains = [(0, 5), (5, 4)]
    _, expected = language_id.marginals(em, np.array([0, 5]), np.array([5, 4]), tr, st, pairs=True)
    for i in range(3):
        for j in range(3):
            eps = np.zeros((3, 3))
            eps[i, j] = 1e-5
            slope = sum(log_likelihood(em[a : a + n], tr + eps, st, y[a : a + n]) - log_likelihood(em[a : a + n], tr - eps, st, y[a : a + n]) for a, n in chains) / 2e-5
            seen = sum(int(y[k] == i and y[k + 1] == j) for a, n in chains for k in range(a, a + n - 1))
            assert abs(seen - expected[i, j] - slope) < 1e-6


TWO = [("xx", ("kata moro kata bira " * 12).split())] * 6 + [("yy", ("zunge feld zunge wald " * 12).split())] * 6


def test_code_switched_words_get_their_own_labels():
    m = language_id.fit(TWO)
    lab = language_id.Labeller(m)
    s = lab.shares([["kata", "bira"], ["zunge", "feld", "wald"], ["kata"] * 8 + ["zunge"] * 2, []])
    assert m.labels[s[0].argmax()] == "xx" and m.labels[s[1].argmax()] == "yy" and m.labels[s[2].argmax()] == "xx" and not s[3].any()
    assert language_id.words("12 ²³ --") == [] and language_id.words(None) == []


def test_a_prediction_equals_enumeration(spark):
    import itertools

    m = language_id.fit(TWO)
    texts = ["kata", "kata zunge", "Moro bira, feld!", "12 --", None, "unbekannt moro", "kata kata zunge feld wald bira"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()}
    for k, t in enumerate(texts):
        w = language_id.words(t)
        if not w:
            assert got[k] == ("und", 0.0)
            continue
        em, n = m.emissions(w), len(m.labels)
        p = np.zeros((len(w), n))
        for y in itertools.product(range(n), repeat=len(w)):
            weight = np.exp(m.start[y[0]] + sum(em[i, y[i]] for i in range(len(w))) + sum(m.transition[y[i], y[i + 1]] for i in range(len(w) - 1)))
            for i in range(len(w)):
                p[i, y[i]] += weight
        share = (p / p.sum(axis=1, keepdims=True)).mean(axis=0)
        assert share[m.labels.index(got[k][0])] > share.max() - 1e-4 and abs(got[k][1] - share.max()) < 1e-4


@pytest.fixture(scope="module")
def subwords():
    return lm_score.Subwords(lm_score.default_path())


def test_pieces_keep_the_text_and_their_ids(subwords):
    odd = ["a b", " a", "a ", "a  b", "a\nb", "a \n b\n\n\nc", "\t x\r\ny", "\u00a0 z \x85q", "it's 12'll ", "", "\n", " "]
    odd += ["".join(RNG.choice(ALPHABET) for _ in range(40)) for _ in range(200)]
    names = {k: t for t, k in subwords.encoding._mergeable_ranks.items()}
    for t in odd:
        raw = t.encode().lower()
        ids = subwords.ids(t)
        shown = b"".join(names[i] for i in ids.tolist())
        if raw:  # a blank before each piece without a line feed: the text can be read back
            assert shown == b"".join(p if p[:1] == b"\n" else b" " + p for p in lm_score.pieces(raw))
            assert b" ".join(lm_score.pieces(raw)).replace(b" \n", b"\n") == raw or b" \n" in raw
            assert ids.tolist() == [i for p in lm_score.pieces(raw) for i in subwords.many([p])[0].tolist()]


def small_network(rng, n=300):
    rows = rng.integers(0, n - 1, (40, lm_score.SPAN + 1))
    return lm_score.new_network(rng.integers(0, 50, n), rows)


def test_language_model_gradients():
    rng = np.random.default_rng(6)
    net = small_network(rng)
    p = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in net.p.items()}
    x = rng.integers(0, 290, (3, lm_score.SPAN)).astype(np.int32)
    y = rng.integers(-1, 290, (3, lm_score.SCORED))
    _, _, grads = lm_score.gradients(p, x, y)
    for name, rows, g in grads:
        full = np.zeros_like(p[name])
        if rows is None:
            full += g
        else:
            np.add.at(full, rows.ravel(), g)
        at = np.unravel_index(np.abs(full).argmax(), full.shape)
        eps = 1e-5
        p[name][at] += eps
        up = lm_score.gradients(p, x, y)[0]
        p[name][at] -= 2 * eps
        down = lm_score.gradients(p, x, y)[0]
        p[name][at] += eps
        assert abs((up - down) / (2 * eps) - full[at]) < 1e-4 * max(1, abs(full[at])), name


def test_probabilities_of_all_ids_sum_to_one():
    rng = np.random.default_rng(7)
    net = small_network(rng, 3000)
    sc = lm_score.Scorer(net)
    x = rng.integers(0, 2900, (1, lm_score.SPAN)).astype(np.int32)
    total = np.zeros(lm_score.SCORED)
    for i in range(3000):
        total += np.exp(sc.log_p(x, np.full((1, lm_score.SCORED), net.out[i]))[0] + net.share[i])
    assert np.allclose(total, 1, atol=1e-3)
    ids = [np.array([5, 7, 9]), np.zeros(0, np.int64), rng.integers(0, 2999, 70)]
    assert np.allclose(sc.text_scores(ids), [sc.text_scores([i])[0] for i in ids])
    # the window of a text is read causally: a later id changes nothing before it
    y = ids[2].copy()
    y[-1] = (y[-1] + 1) % 2999
    a, b = (sc.log_p(lm_score.windows([i], net.slot)[0], net.out[np.maximum(lm_score.targets([ids[2]], np.array([3]), net.end), 0)]) for i in (ids[2], y))
    assert np.allclose(a.ravel()[:70], b.ravel()[:70])


def test_every_id_is_scored_once():
    ids = [np.arange(n) for n in (0, 1, 31, 32, 33, 100)]
    slot = np.arange(200, dtype=np.int32)
    _, count = lm_score.windows(ids, slot)
    y = lm_score.targets(ids, count, 199).ravel()
    at = 0
    for i, c in zip(ids, count.tolist(), strict=True):
        own = y[at : at + c * lm_score.SCORED]
        assert own[own >= 0].tolist() == [*i.tolist(), 199]
        at += c * lm_score.SCORED


def test_drawn_windows_are_runs_of_their_text(subwords):
    texts = [(" ".join(RNG.choice(["alpha", "be", "gam\nma", "x."]) for _ in range(n))).encode() for n in (3, 30, 300)]
    for t in texts:
        whole = [subwords.size + 1, *subwords.ids(t.decode()).tolist(), subwords.size]
        h, rows = lm_score.drawn(subwords, [t], 20)
        assert len(h) >= len(t) // 20
        for r in rows.tolist():
            own = [i for i in r if i != subwords.size + 2]
            assert any(whole[k : k + len(own)] == own for k in range(len(whole)))


def texts_of(ids, size):
    import pyarrow as pa

    raw = [np.array(i, lm_score._kind(size)).tobytes() for i in ids]
    return pa.RecordBatch.from_arrays([pa.array(range(len(raw)), pa.int64()), pa.array(raw, pa.binary())], names=["row", "ids"])


def test_every_id_of_every_text_is_learned_once():
    rng = np.random.default_rng(8)
    for size in (300, 70_000):  # ids of two bytes and of four
        ids = [rng.integers(0, size, n) for n in (0, 1, 31, 32, 33, 100, lm_score.BLOCK * lm_score.SCORED, 3 * lm_score.BLOCK * lm_score.SCORED + 7)]
        blocks = list(lm_score._blocks(size)(iter([texts_of(ids, size)])))
        got = list(lm_score._pools(iter(blocks), size, 40))
        assert len(got) > 2
        rows = np.concatenate(got)
        _, count = lm_score.windows(ids, np.arange(size, dtype=np.int32))
        want = lm_score.targets(ids, count, size)  # the windows are those that are scored
        have = rows[:, lm_score.CONTEXT + 1 :]
        assert sorted(np.where(have > size, -1, have).tolist()) == sorted(want.tolist())


def test_company_is_counted_over_all_texts():
    rng = np.random.default_rng(10)
    size = 3000
    place = lm_score.most_used(rng.integers(0, 50, size + 1))[1]
    ids = [rng.integers(0, size, n) for n in (0, 1, 5, 400)]
    want = np.zeros((lm_score.RARE + 1, lm_score.NEAR), np.int64)
    for i in ids:
        before = lm_score.RARE
        for k in place[[*i, size]].tolist():
            if before < lm_score.NEAR:
                want[k, before] += 1
            before = k
    batches = [texts_of(ids[:2], size), texts_of(ids[2:], size)]
    got = np.zeros_like(want)
    for part in lm_score._add_company(p for b in batches for p in lm_score._company(place)(iter([b]))):
        for at, n in zip(part["at"].to_pylist(), part["n"].to_pylist(), strict=True):
            got[at : at + 64] += np.frombuffer(n, np.int64).reshape(-1, lm_score.NEAR)
    assert (got == want).all()


def test_a_step_sums_the_gradients_of_each_row():
    rng = np.random.default_rng(12)
    for n_rows in (5, 400, 70_000):
        rows = rng.integers(0, n_rows, (6, 20)).astype(np.int32)
        p, steps, touched = {"t": rng.standard_normal((n_rows, 3)).astype(np.float32)}, {"t": np.full(n_rows, 0.1, np.float32)}, {"t": np.zeros(n_rows, np.float32)}
        g = rng.standard_normal((120, 3)).astype(np.float32)
        total = np.zeros((n_rows, 3))
        np.add.at(total, rows.ravel(), g * 2.0)
        size = 0.1 + (total**2).mean(axis=1)
        want = p["t"] - 0.3 * total / np.sqrt(size)[:, None]
        lm_score.descend(p, steps, [("t", rows, g)], 50, 0.3, touched)
        assert np.allclose(p["t"], want, atol=1e-5) and np.allclose(steps["t"], size, atol=1e-4)
        assert (np.flatnonzero(touched["t"]) == np.unique(rows)).all() and touched["t"].max() == 1


def test_a_reader_keeps_the_pieces_it_meets_most(subwords, monkeypatch):
    monkeypatch.setattr(lm_score, "MEMORY", 60)
    rng = np.random.default_rng(13)
    often = [f"w{k}" for k in range(20)]
    head = {w.encode(): 1.0 + k for k, w in enumerate(often)} | {lm_score.END: 0.5}
    encoded = []
    many = lm_score.Subwords.many
    monkeypatch.setattr(lm_score.Subwords, "many", lambda self, some: (encoded.extend(some), many(self, some))[1])
    reader = lm_score.Reader(head, subwords)
    for k in range(12):  # 50 pieces of its own each time, so that the memory runs over again and again
        texts = [" ".join([*rng.permutation(often * 3).tolist(), *(f"q{k}x{j}" for j in range(50)), "\n", "a\tw3\nw4 ", ""]).encode(), b"", b"\n\nw1"]
        ids, n, known, value, other = reader.read(texts)
        for i, t in enumerate(texts):
            words = t.split()
            tail = [w for w in words if w not in head]
            assert ids[i].tolist() == many(subwords, lm_score.pieces(t))[0].tolist() if t else len(ids[i]) == 0
            assert (n[i], known[i], other[i]) == (len(words), len(words) - len(tail), {w: tail.count(w) for w in tail})
            assert abs(value[i] - sum(head.get(w, 0) for w in words)) < 1e-9
    assert len(reader.index) < 60 + 100 and max(encoded.count(w.encode()) for w in often) == 1


def test_rows_of_even_width_are_summed_alike():
    rng = np.random.default_rng(14)
    for width in (1, 3, 8, lm_score.WIDTH):
        rows = rng.integers(0, 40, (6, 20)).astype(np.int32)
        p, steps = {"t": rng.standard_normal((50, width)).astype(np.float32)}, {"t": np.full(50, 0.1, np.float32)}
        g = rng.standard_normal((120, width)).astype(np.float32)
        total = np.zeros((50, width))
        np.add.at(total, rows.ravel(), g * 2.0)
        size = 0.1 + (total**2).mean(axis=1)
        want = p["t"] - 0.3 * total / np.sqrt(size)[:, None]
        lm_score.descend(p, steps, [("t", rows, g)], 50, 0.3)
        assert np.allclose(p["t"], want, atol=1e-5) and np.allclose(steps["t"], size, atol=1e-4)


def test_counts_of_pieces_and_words():
    import pyarrow as pa
    from collections import Counter

    odd = ["a b", " a", "", None, "A  b\n", "a\nb\n\n\nc", "\t x\r\ny z\tz", "\n", " "]
    want = Counter()
    for t in odd:
        raw = (t or "").encode().lower()
        for w in [*raw.split(), lm_score.END]:
            want[w, "c"] += 1
        for x in lm_score.pieces(raw) if raw else []:
            want[x[1:] if x[:1] == b"\n" else x, "line" if x[:1] == b"\n" else "space"] += 1
    got = Counter()
    for part in lm_score._count(iter([pa.RecordBatch.from_arrays([pa.array(odd)], names=["text"])])):
        for r in part.to_pylist():
            for c in ("c", "space", "line"):
                got[r["word"], c] += r[c]
    assert +got == +want
