"""Truncation: the censored fit, the evidence of endings, and planted cuts."""

import random

import numpy as np

from lodestrata.llm import truncation as T

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, evidence double, gram string"
SENTENCES = [
    "The queue began to grow and the consumers could not keep up.", "Nobody noticed the alert because it had been muted during the last release.", "Every call carries a deadline of three hundred milliseconds.",
    "Backups are restored into a scratch cluster every month.", "Roll back the release and compare the error rate with last week.", "The certificate had expired and was renewed by hand.",
]


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(1)
    x = rng.normal(6.0, 0.8, 20_000)
    cut = np.log(500)
    seen, hidden = x[x < cut], (x >= cut).sum()
    at, n = np.append(seen, cut), np.append(np.ones(len(seen)), hidden)
    mean, dev = T.fit_censored(at, n, np.append(np.zeros(len(seen), bool), True))
    assert abs(mean - 6.0) < 0.05 and abs(dev - 0.8) < 0.05


def test_looks_of_endings():
    want = {
        "ends in \ufffd": "broken", "so far [message truncated]": "said", "x [truncated " + "y" * 500 + "]": "said", "cut off here (truncated)": "said", "```\ncode\n```": "fence", "```\ncode": "in-fence",
        "| a | b |": "row", "| a | b": "in-row", 'msg="abc': "opened", "and so ...": "dots", "and so on \t": "space", "It ends.": "stops", "It ends": "plain", "   ": "blank", "f(a": "opened", "[1] and [2]": "plain",
    }
    assert {t: T._sign(t)[0] for t in want} == want


def test_the_likelier_fit_is_taken():
    rng = np.random.default_rng(4)
    for x, better in ((np.exp(rng.normal(6.0, 0.7, 20_000)), T._lognormal), (rng.weibull(4.0, 20_000) * 900, T._weibull)):
        at = np.append(x[x < 800], 800.0)
        n, censored = np.append(np.ones(len(at) - 1), (x >= 800).sum()), np.append(np.zeros(len(at) - 1, bool), True)
        fits = {f: f(at, n, censored) for f in (T._lognormal, T._weibull)}
        assert max(fits, key=lambda f: fits[f][0]) is better


def test_posterior_outweighs_a_doubtful_ending():
    import pandas as pd

    cells = pd.DataFrame([("plain", "-4", None, 900), ("plain", "12", None, 20), ("plain", "-4", 0.99, 80), ("stops", "none", None, 9_000)], columns=["sign", "words", "prior", "n"])
    learned, rate = T.learn_evidence(cells, 0.02)
    odds = {(r.sign, r.words): r.odds for r in learned.itertuples()}
    assert np.log(0.99 / 0.01) + odds["plain", "-4"] > 0 > np.log(rate / (1 - rate)) + odds["plain", "-4"] and ("stops", "none") not in odds
    assert len(T.learn_evidence(cells.iloc[3:], 0.02)[0]) == 0


def corpus():
    rng = random.Random(7)
    rows, cut, i = [], set(), 0
    for source, limit in (("limited", 300), ("free", None)):
        for _ in range(700):
            text = " ".join(rng.choice(SENTENCES) for _ in range(rng.randint(1, 9)))
            if rng.random() < 0.1:
                text += "\n\nThanks"
            i += 1
            if limit and len(text) > limit:
                text = text[:limit]
                if text[-1] not in ".\n" and not text.endswith("Thanks"):
                    cut.add(i)
            elif source == "free" and rng.random() < 0.05:
                text = text[: rng.randint(20, len(text) - 1)]
                if text[-1] != ".":
                    cut.add(i)
            rows.append((i, text, source, 0, 0.0, "x"))
    return rows, cut


def test_planted_cuts_are_found(spark):
    rows, cut = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    found = T.truncated_documents(df).cache()
    got = {r.doc_id for r in found.where("cut").collect()}
    assert len(got & cut) / len(cut) >= 0.95 and len(got & cut) / len(got) >= 0.95
    rates = {r.source: r for r in T.truncation_rates(found).collect()}
    assert rates["limited"].n_at_limit > 100 and rates["free"].n_at_limit <= 5 and rates["free"].n_texts == 700


def test_untidy_rows(spark):
    long = "word " * 60_000
    rows = [(1, None, "a", 0, 0.0, ""), (2, "", "a", 0, 0.0, ""), (None, "x", "a", 0, 0.0, ""), (3, "One line.", None, 0, 0.0, ""), (3, "One line.", None, 0, 0.0, ""), (4, long, "a", 0, 0.0, ""), (5, "   ", "a", 0, 0.0, "")]
    got = {r.doc_id: r.source for r in T.truncated_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {3: "", 4: "a", 5: "a"}
    empty = T.truncated_documents(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and T.truncation_rates(empty).count() == 0


def test_copies_change_no_verdict(spark):
    rows, _ = corpus()
    texts = [SENTENCES[0] + " The certificate had expired and was renew", SENTENCES[2] + " Restored into a scratch clust", SENTENCES[1] + " Backups are restored every month"]
    single = [(10_000 + k, t, "free", 0, 0.0, "x") for k, t in enumerate(texts)]
    copies = [(20_000 + 1000 * k + i, t, "free", 0, 0.0, "x") for k, t in enumerate(texts) for i in range(300)]
    one = {r.doc_id: (r.cut, round(r.posterior, 6)) for r in T.truncated_documents(spark.createDataFrame(rows + single, SCHEMA)).where("doc_id >= 10000").collect()}
    many = {r.doc_id: (r.cut, round(r.posterior, 6)) for r in T.truncated_documents(spark.createDataFrame(rows + single + copies, SCHEMA)).where("doc_id >= 10000").collect()}
    assert one[10_000][0]
    assert all(many[i] == one[10_000 + (0 if i < 20_000 else (i - 20_000) // 1000) + (i - 10_000 if i < 20_000 else 0)] for i in many) and len(many) == 903


def test_counts_may_be_handed_over_at_any_time(monkeypatch):
    import pandas as pd

    texts = [" ".join(random.Random(i).choice(SENTENCES) for _ in range(4)) + "\nNo stop here\nThe end." for i in range(30)]
    total = lambda: pd.concat(list(T.gram_counts(iter([pd.DataFrame({"text": texts})])))).groupby("gram").sum().sort_index()
    whole = total()
    monkeypatch.setattr(T, "HELD_GRAMS", 5)
    assert total().equals(whole) and whole.loc["3 No stop here", "n_end"] == 30
