"""Language, quality, toxicity and personal data: plain versions, held-out rows, edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumicell.llm import language_id, pii, quality, queries, toxicity
from tests.llm.util import EDGES, documents, words


def test_language_model_on_held_out_rows(spark):
    rng = random.Random(5)
    alphabets = {"aa": "abcde ", "bb": "bcdxyz ", "ü": "üöäde "}
    rows = [(k, "".join(rng.choice(a) for _ in range(80)), l) for k, (l, a) in enumerate(list(alphabets.items()) * 60)]
    model = language_id.fit(documents(spark, rows[:120]))
    got = {r.doc_id: r for r in language_id.predict(documents(spark, rows[120:] + [(900, None, None), (901, "12 ?!", "aa"), (902, "", None), (903, "\U000f0000\U0010ffff \ue000", "aa"), (904, "abcde " * 100_000, "bb")]), model).collect()}
    assert sum(got[i].lang_pred == l for i, _, l in rows[120:]) >= 0.97 * 60
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und"] * 4 and got[904].lang_pred == "aa"
    kept = language_id.keep_identified(documents(spark, rows[120:] + [(900, None, None), (901, "12 ?!", "aa")]), model)
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in rows[120:]}
    assert language_id.keep_identified(documents(spark, []), model).count() == 0
    empty = language_id.fit(documents(spark, []))
    assert [r.lang_pred for r in language_id.predict(documents(spark, EDGES[3:4]), empty).collect()] == ["und"]
    assert {r.doc_id for r in language_id.keep_identified(documents(spark, EDGES), empty).collect()} == {4, 5, None}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_separate_and_handle_edges(spark, module):
    rows = []
    for k in range(240):
        w = words(40, k, 150)
        bad = k % 4 == 0
        if bad:
            w = [x + "&&&" for x in w] if module is quality else [*w[:20], "vileword", *w[20:]]
        rows.append((k, " ".join(w), int(not bad) if module is quality else int(bad)))
    frame = lambda r: spark.createDataFrame(r, "doc_id bigint, text string, label int")
    model = module.fit(frame(rows[:160] + [(1000, None, 1), (1001, "x", None)]))
    got = {r.doc_id: r.score for r in module.predict(documents(spark, [(i, t, None) for i, t, _ in rows[160:]] + EDGES + [(2000, "w1 w2 &&& " * 60_000, None)]), model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows[160:]]) > 0.95
    assert module.predict(documents(spark, []), module.fit(frame([]))).count() == 0


def test_swapped_identity_terms_keep_their_score():
    rows = [np.array([0, 2]) if k % 3 else np.array([1]) for k in range(90)]  # 2: a term that goes along with the label
    y = np.array([1.0 if k % 3 else 0.0 for k in range(90)])
    free, _ = toxicity._fit_weights(rows, y, [], 4)
    held, _ = toxicity._fit_weights(rows, y, [(np.array([2]), np.array([3]))] * 20, 4)
    assert abs(held[2] - held[3]) < 0.3 * abs(free[2] - free[3])


def plain_spans(t):
    def luhn(d):
        total = 0
        for k, c in enumerate(d[::-1]):
            x = int(c) * (1 + k % 2)
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    s = [(1, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    s += [(2, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda x: re.sub("[^0-9]", "", x)
    s += [(3, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return s + [(4, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a0123459.@+- ()_\né", max_size=60))
def test_base_spans_match_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_message_passing_is_exact_on_a_chain():
    rng = np.random.default_rng(9)
    f = pii.SkipChainField(rng.normal(size=(pii.FEATURES, pii.K)), rng.normal(size=(pii.K, pii.K)), rng.normal(size=(pii.K, pii.K)))
    g = pii.graph(["a1 b22 c@x"], [[]])
    p = f.marginals(g)
    own, n = g.shapes @ f.node, len(g.label)
    total = np.zeros((n, pii.K))
    for y in np.ndindex(*[pii.K] * n):
        w = np.exp(sum(own[i, y[i]] for i in range(n)) + sum(f.chain[y[i], y[j]] for i, j in g.chain) + sum(f.skip[y[i], y[j]] for i, j in g.skip))
        for i in range(n):
            total[i, y[i]] += w
    assert np.allclose(p, total / total.sum(axis=1, keepdims=True), atol=1e-3)

def test_counterfactuals_swap_or_put_in_a_term():
    group = toxicity.IDENTITY["belief en"]
    pairs = toxicity.counterfactuals("The Muslim family met a muslim friend")
    assert len(pairs) == toxicity.SWAPS and all(a == "The Muslim family met a muslim friend" for a, _ in pairs)
    assert all(b in {f"The {t} family met a {t} friend" for t in group if t != "muslim"} for _, b in pairs)
    pairs = toxicity.counterfactuals("nothing is named here")
    assert pairs[0][0] == "nothing is named here" and all(len(b.split()) == 5 for _, b in pairs) and all(len(a.split()) == 5 for a, _ in pairs[1:])


def test_penalty_lowers_scores_of_neutral_mentions(spark):
    """A term that goes along with toxic rows: the penalty keeps neutral rows that name it low."""
    rows = []
    for k in range(300):
        toxic = k % 3 == 0
        w = words(20, k, 200)
        rows.append((k, " ".join([*w[:10], *(["vileword", "muslim"] if toxic else ["jewish"] if k % 9 == 1 else []), *w[10:]]) + ".", int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    neutral = [" ".join([*words(20, 900 + k, 200), "muslim", "neighbours"]) for k in range(40)]
    scores = {}
    for weight in (0.0, 200.0):
        model = toxicity.fit(frame, swap_weight=weight)
        scores[weight] = model.score(pa.array(neutral)).mean(), toxicity.score_gap(model, neutral)
        assert (model.score(pa.array([t for _, t, y in rows if y])) >= 0.5).mean() > 0.95
    assert scores[200.0][0] < 0.5 * scores[0.0][0] and scores[200.0][1] < 0.5 * scores[0.0][1]


def test_field_adds_spans_by_shape_and_context(spark):
    rng = random.Random(6)
    number = lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    train = []
    for k in range(400):
        n = number()
        more = [f"again +1 {n} now", f"ticket {rng.randrange(10**7)} done", f"+1 {number()} {rng.randrange(255)}.0.2.{k % 250}", f'token = "{secret()}" set', f"version 2.{k % 9} of {rng.randrange(2000, 2030)}"][k % 5]
        train.append((k, f"call +1 {n} or x{k} 12 items 2024, mail a{k}@b.org. {more}", None))
    field = pii.fit(documents(spark, train))
    hidden = secret()
    text = f"é write to jane.doe77@mail.example.org today; number 20240101 x. Call (262) 555-3752 or +1 (262) 555-3752 10.0.0.1 or so, api_key: {hidden}, version 3.1"
    rows = [(1, text, None), *EDGES[1:], (9, "9" * 20_000 + " " + "a@" * 3000 + " w" * 100_000, None)]
    got = {r.doc_id: r for r in pii.find(documents(spark, rows), field).collect()}
    base = [(s.kind, text[s.start : s.end]) for s in got[1].base]
    assert base == [("email", "jane.doe77@mail.example.org"), ("ip", "10.0.0.1")]
    assert set(got[1].base) <= set(got[1].spans)
    added = {(s.kind, text[s.start : s.end]) for s in set(got[1].spans) - set(got[1].base)}
    assert added == {("phone", "(262) 555-3752"), ("phone", "+1 (262) 555-3752"), ("secret", hidden)}
    assert got[2].spans == [] and got[4].spans == []
    assert pii.find(documents(spark, []), pii.fit(documents(spark, []))).count() == 0


def test_equal_and_split_numbers_are_linked():
    text = "4111 1111 1111 1111 x 4111111111111111 y (262)5553752 z +1 (262) 555-3752 w 262-555-3752"
    rows, _, _, chain, skip = pii._tokens(text, [])
    said = [text[a:b] for a, b in rows]
    linked = {(said[a], said[b]) for a, b in skip}
    assert {("1111", "4111111111111111"), ("(262)5553752", "555-3752"), ("555-3752", "262-555-3752")} <= linked
    assert ("+1", "(262)") in {(said[a], said[b]) for a, b in chain}


def test_a_token_takes_the_kind_of_its_observed_twin():
    skip = np.where(np.eye(pii.K) > 0, 4.0, 0.0)
    f = pii.SkipChainField(np.zeros((pii.FEATURES, pii.K)), np.zeros((pii.K, pii.K)), skip)
    g = pii.graph(["a1234567890x and a1234567890x"], [[(4, 0, 12)]])
    assert len(g.skip) == 1 and f.marginals(g)[1].argmax() == 4 and f.marginals(g)[1, 4] > 0.9


def labelled(name, column):
    docs = pq.read_table(f"/root/testdata/{name}/documents.parquet").to_pandas()
    labels = pq.read_table(f"/root/testdata/{name}/labels.parquet").to_pandas()
    return docs.merge(labels[labels[column].notna()], on="doc_id")


def test_held_out_results_of_the_queries(spark):
    """Languages, quality and toxicity of rows that nothing was learned from."""
    d = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{d}/documents.parquet").to_pandas()
    lang = queries.op2_language_id(spark, d).toPandas().merge(docs, on="doc_id")
    held = lang[lang.held_out & lang.lang.notna() & lang.text.fillna("").str.contains(r"[^\W\d_]{2}")]
    assert len(lang) == len(docs) and (held.lang_pred == held.lang).mean() > 0.98
    for query, column, least in ((queries.op3_quality_classifier, "quality", 0.95), (queries.op9_toxicity, "toxic", 0.94)):
        out = query(spark, d).toPandas()
        known = out.merge(labelled("sf0.01", column)[["doc_id", column]], on="doc_id")
        known = known[known.held_out]
        assert len(out) == len(docs) and out.score.between(0, 1).all() and len(known) > 50
        assert (known.predicted == known[column]).mean() > least


def test_language_scores_match_plain_counting(spark):
    """The model and its scores by plain dictionaries over the n-grams of each text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    model = language_id.fit(docs, 10**6)

    def grams(text):
        t = " " + re.sub(r"[\W\d_]+", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
        for k in (1, 2, 3):
            for a in range(len(t) - k + 1):
                h = 0
                for j, c in enumerate(t[a : a + k]):
                    h = (h * 0x85EBCA77 * (j > 0) + ord(c) * 0x9E3779B1) & 0xFFFFFFFF
                g = h ^ (h >> 15)
                yield ((g * 0xC2B2AE3D) & 0xFFFFFFFF) >> 18

    counts = {}
    for _, t, l in rows:
        if t is not None and l is not None and any(c.isalpha() for c in t):
            own = counts.setdefault(l, {})
            for g in grams(t):
                own[g] = own.get(g, 0) + 1
    assert sorted(counts) == model.languages
    total = {l: sum(c.values()) + 0.5 * language_id.BUCKETS for l, c in counts.items()}
    for _, t, _ in rows[:40]:
        got, p = model.score([t or ""])
        if not any(c.isalpha() for c in t or ""):
            assert got == ["und"] and p[0] == 0
            continue
        held = list(grams(t))
        z = [sum(np.log((counts[l].get(g, 0) + 0.5) / total[l]) for g in held) / max(1, len(held) / language_id.TEMPER) + model.prior[k] / len(held) for k, l in enumerate(model.languages)]
        e = np.exp(np.array(z) - max(z))
        assert got[0] == model.languages[int(np.argmax(z))] and abs(p[0] - e.max() / e.sum()) < 1e-6
