"""Disguises, features, learnt evidence, the trees, calibration and held-out accuracy."""

import os

import numpy as np
import pytest

from tidelog.llm import abuse as A
from tidelog.llm import evidence as E
from tidelog.llm import lexicon as L
from tidelog.llm import reveal as R
from tidelog.llm.trees import Trees, isotonic

SF = "/root/testdata/sf0.1"
DOCS = "doc_id bigint, text string, source string, score double, features int"


def skeletons(text):
    return [L.skeleton(w) for w in R.words(text)]


@pytest.mark.parametrize(
    "text,word",
    [
        ("you m.o.r.o.n", "moron"), ("n u d e s please", "nudes"), ("send n_u_d_e_s", "nudes"), ("p-a-t-h-e-t-i-c", "pathetic"), ("you m0r0n", "moron"),
        ("m#ron!", "moron"), ("fuckkkkking", "fucking"), ("IMBECIIILE", "imbecile"), ("jaaackass", "jackass"), ("i-\ndiot", "idiot"), ("suc- k my cock", "suck"),
        ("p­ath​etic", "pathetic"), ("jасkаss", "jackass"), ("Ar5chl0ch", "arschloch"), ("Crève", "creve"), ("worthl*ss", "worthless"),
        ('{"cells": [{"source": ["you mo-\\n", "ron"]}]}', "moron"), ('{"cells": ["imb\\u00e9cil"]}', "imbecil"), ("a mo<b>ron</b>", "moron"),
        ("\x1b[31mmoron\x1b[0m", "moron"), ("m&#111;ron", "moron"), ("ldiotic", "idiotic"), ('{"a": "' + "x" * 5000 + '", "cells": ["\\u006doron"]}', "moron"),
    ],
)
def test_disguises(text, word):
    assert L.skeleton(word) in skeletons(text)


@pytest.mark.parametrize("sep", ["/", "+", "=", "_", "-"])
def test_abuse_joined_by_signs_is_read(sep):
    v = A.vector(sep.join(["you", "fucking", "moron"] * 20))
    assert v[A.AT["insult_n"]] == 20 and v[A.AT["profane_n"]] == 20


def test_encoded_images_hold_no_words():
    import base64

    data = base64.b64encode(np.random.default_rng(0).bytes(300_000)).decode()
    wrapped = "\n".join(data[i : i + 76] for i in range(0, len(data), 76))
    for text in (data, wrapped, '{"image/png": "' + data + '"}'):
        assert not A.vector(text)[: L.N_HOT].any()


#: One text for each feature that the first two do not set.
MIXED = "you stupid moron, the sensor of these Gays people: fuck, kill, vermin, porn, naked, i said so"
MADE = {
    "caps_rate": "you moron, SEE THE Table", "caps_hits": "you MORON", "bang_rate": "you moron!", "question_rate": "moron?", "hits_unplain": "moron",
    "disguised_hits": "you m0r0n", "disguised_rate": "you m0r0n", "invisible_rate": "you mo​ron", "hate_near_name": "the Velvarians are vermin",
    "mild_near_name": "all the velvarians are stupid", "hot_less_plain": "stupid moron", "threat_near_second": "kill you", "hate_near_second": "you vermin",
    "sexual_near_second": "your porn", "mild_sexual_near_second": "you naked",
}


@pytest.mark.parametrize("name", [f for f in A.FEATURES if not f.startswith("learnt_")])
def test_each_feature_is_set_by_a_text_made_for_it(name):
    assert A.vector(MADE.get(name, MIXED))[A.AT[name]] > 0


def test_rates_are_what_their_names_say():
    text = "Moron, is it SO? SO?! SO!!!"
    v = dict(zip(A.FEATURES, A.vector(text).tolist()))
    assert [round(v[f] * len(text)) for f in ("caps_rate", "bang_rate", "question_rate")] == [7, 4, 2]
    assert (v["hits_unplain"], v["caps_hits"], v["disguised_hits"], v["invisible_rate"]) == (1, 0, 0, 0)


def test_nearness_falls_with_distance():
    at = [A.vector("you " + "step " * k + "moron")[A.AT["insult_near_second"]] for k in range(12)]
    assert at == [max(A.WINDOW - k, 0) for k in range(12)]


def test_learnt_features_follow_the_weights():
    texts = ["quartz lamp under the bridge", "plain words only", "you moron " * 3]
    _, _, codes, doc, rates = next(A._read(texts))
    at, h = next(E.patterns(codes, doc))
    hashes = np.unique(h[[0, 1]])
    weight = np.full(len(hashes), 3.0, np.float32)
    x = A.vectors(codes, doc, rates, E.Lookup(hashes), weight)
    assert x[0, A.AT["learnt_best"]] == 6 and x[0, A.AT["learnt_strong"]] == 2 and not x[1:, A.AT["learnt_best"]].any()
    low = A.vectors(codes, doc, rates, E.Lookup(hashes), -weight)
    assert low[0, A.AT["learnt_least"]] == 6 and low[0, A.AT["learnt_strong"]] == 0
    # The patterns of a document do not depend on its neighbours.
    alone = A.vector(texts[0], E.Lookup(hashes), weight)
    assert (alone == x[0]).all()


def test_patterns_do_not_reach_over_documents():
    _, _, codes, doc, _ = next(A._read(["one two three four", "five"]))
    joined = {int(h) for _, hs in E.patterns(codes, doc) for h in hs}
    apart = set()
    for t in ("one two three four", "five"):
        _, _, c, d, _ = next(A._read([t]))
        apart |= {int(h) for _, hs in E.patterns(c, d) for h in hs}
    assert joined == apart


def test_lookup_finds_what_is_there():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 5000).astype(np.uint64)
    known = np.unique(h[:700])
    where, which = E.Lookup(known).find(h)
    assert set(where.tolist()) == set(np.flatnonzero(np.isin(h, known)).tolist()) and (known[which] == h[where]).all()


@pytest.mark.parametrize(
    "text,names",
    [
        ("你这个白痴东西", ("insult_n", "second_density")), ("他真是个混蛋啊", ("insult_n",)), ("このクズが", ("insult_n",)), ("お前は馬鹿だ", ("insult_n", "second_density")),
        ("みんなﾊﾞｶだ", ("insult_n",)), ("早く死ねよ", ("threat_n",)), ("我们做爱吧", ("sexual_n",)), ("白​痴东西", ("insult_n",)),
    ],
)
def test_words_of_scripts_without_blanks(text, names):
    v = A.vector(f"# {text}。 the mean of the readings")
    assert all(v[A.AT[n]] > 0 for n in names)


@pytest.mark.parametrize("text", ["ボックスを開ける", "夏のバカンスに行く", "平均値を計算する", "计算每一列的平均值"])
def test_no_listed_word_in_plain_loan_words(text):
    assert not A.vector(text)[: L.N_HOT].any()


@pytest.mark.parametrize("text", [None, "", " ", "\x00", "🙂" * 50, "a" * 100_000, "ивор漢字", "!!!", "{", "fuck " * 3000, "\\ud83d", "İ" * 9, "a b c d " * 5000])
def test_any_text_has_a_vector(text):
    v = A.vector(text)
    assert v.shape == (len(A.FEATURES),) and np.isfinite(v).all()


def test_whole_words_only():
    v = A.vector("classic analysis of grass and bass assessments, dickens and hitchcock in the cockpit")
    assert not v[[A.AT["insult_n"], A.AT["sexual_n"], A.AT["profane_n"]]].any()


def test_slices_do_not_change_vectors(monkeypatch):
    texts = ["you stupid moron", None, "the sensor", "kill them all", "", "x " * 500]
    whole = [A.vectors(c, d, r) for _, _, c, d, r in A._read(texts)]
    monkeypatch.setattr(A, "SLICE_CHARS", 1)
    parts = [A.vectors(c, d, r) for _, _, c, d, r in A._read(texts)]
    assert len(whole) == 1 and len(parts) > 2 and (np.concatenate(parts) == whole[0]).all()


@pytest.mark.parametrize("seed", range(4))
def test_isotonic_is_the_best_monotone_fit(seed):
    rng = np.random.default_rng(seed)
    s, y = rng.integers(0, 12, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    at, value = isotonic(s, y)
    fit = value[np.searchsorted(at, s, "right") - 1]
    assert (np.diff(value) > -1e-12).all() and (np.diff(at) > 0).all()
    loss = ((fit - y) ** 2).sum()
    # No monotone step function on the same scores does better.
    for _ in range(300):
        other = np.sort(rng.random(12))[s.astype(int)]
        assert loss <= ((other - y) ** 2).sum() + 1e-9


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((1500, len(A.FEATURES))).astype(np.float32)
    y = ((x[:, 3] > 0.5) ^ (x[:, 20] > 0.5)).astype(float)
    m = Trees(rounds=80, rate=0.3, least=1.0).fit(x[:1000], y[:1000])
    assert (((m.margin(x[1000:]) > 0) == y[1000:]).mean()) > 0.9


def test_without_labels_nothing_is_learnt(spark):
    docs = spark.createDataFrame([(1, "fuck off, you stupid moron", "a", 0.0, 1), (1, "fuck off, you stupid moron", "A ", 0.0, 1), (2, None, None, 0.0, 1), (3, "", "a", 0.0, 1), (None, "a plot", "b", 0.0, 1)], DOCS)
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0), (3, 1)], "doc_id bigint, toxic int")
    scored = A.scores(docs, labels)
    got = sorted([(r.doc_id, r.score) for r in scored.collect()], key=repr)
    assert got == sorted([(1, 0.0), (1, 0.0), (2, 0.0), (3, 0.0), (None, 0.0)], key=repr)
    rate = {r.source: (r.documents, r.flagged) for r in A.rates(scored).collect()}
    assert rate == {"a": (3, 0), None: (1, 0), "b": (1, 0)}
    assert A.scores(docs.limit(0), labels.limit(0)).count() == 0


def test_words_that_no_list_has_are_learnt(spark):
    rng = np.random.default_rng(3)
    calm = lambda: " ".join(rng.choice([f"word{chr(97 + i)}" for i in range(26)], 60))
    data = [(i, calm() + (" they reek of old turnips " if i % 3 == 0 else " they sell fresh turnips ") + calm(), "s", 0.0, 1) for i in range(240)]
    docs = spark.createDataFrame(data + [(900, None, "s", 0.0, 1), (0, data[0][1], "s", 0.0, 1)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score >= 0.5 for r in A.scores(docs, labels).collect()}
    assert got == {**{i: i % 3 == 0 for i in range(240)}, 900: False}


def test_labelled(spark):
    data = [(1, 1), (1, 1), (1, 0), (2, 0), (2, 1), (3, None), (None, 1), (4, 0)]
    got = {r.doc_id: r.y for r in A.labelled(spark.createDataFrame(data, "doc_id bigint, toxic int")).collect()}
    assert got == {1: 1.0, 4: 0.0}


#: Written for this test; in none of the tables.
OWN = [
    ("shut up you worthless piece of shit", True), ("you are such a fucking idiot, go and die", True), ("only a moron like you could write this", True),
    ("i will kill you and burn your house", True), ("all foreigners are vermin and should be deported", True), ("you stupid bitch, nobody likes you", True),
    ("send me nudes, i want your wet pussy", True), ("what a dumb asshole you are", True), ("gays are filthy animals and should die", True), ("he put his cock in her mouth and she moaned", True),
    ("kill the parent process before the child", False), ("the patients had breast cancer and a skin rash", False), ("garbage collection is stupid slow here", False),
    ("the master node sends jobs to each slave", False), ("my silly mistake, i forgot the dumb minus sign", False), ("the cock and the hen were weighed on the farm", False),
    ("the comment was removed by a moderator", False), ("a dirty read of rows in the transaction", False), ("execute the script and abort on failure", False), ("the model suffers from dead neurons", False),
]


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").repartition(8)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return A.fit(docs, labels.filter("doc_id % 2 = 0")), docs, labels


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_own_sentences(fitted):
    model = fitted[0]
    around = "import numpy as np\nx = np.mean(readings)\n# {}\nprint(x)\nThe table lists the mean of each station."
    x = np.array([A.vector(around.format(t), E.Lookup(model.evidence.hashes), model.evidence.all) for t, _ in OWN])
    right = (model.score(x) >= 0.5) == np.array([v for _, v in OWN])
    assert right.mean() >= 0.8, [t for (t, _), ok in zip(OWN, right) if not ok]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_held_out_accuracy(fitted):
    """Fitted on the labels of even ids, asked about the odd ones; a few percent of the labels are wrong by design, so
    agreement cannot reach 1."""
    from pyspark.sql import functions as F

    model, docs, labels = fitted
    odd = docs.join(F.broadcast(A.labelled(labels.filter("doc_id % 2 = 1"))), "doc_id").select("text", "y").collect()
    x = np.array([A.vector(r.text, E.Lookup(model.evidence.hashes), model.evidence.all) for r in odd])
    y = np.array([r.y for r in odd])
    flagged = model.score(x) >= 0.5
    assert (flagged == y).mean() > 0.92
    assert y[flagged].mean() > 0.8
