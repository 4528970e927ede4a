"""Operators made of DataFrame expressions: chat, quality, mixing, URLs."""

import hashlib
import math
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmerge.llm import chat, mixing, quality, urls

DOCS = "doc_id long, text string, source string"
TURNS = "conv_id long, turn long, role string, text string"
few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def formatted(spark, rows, schema=TURNS):
    made = chat.format_conversations(spark.createDataFrame(rows, schema))
    made = made.withColumns({"turns": chat.read_turns(made["formatted"]), "loss": chat.read_loss(made["formatted"], made["loss_spans"])})
    return {r["conv_id"]: r for r in made.collect()}


def test_chat_round_trip_with_control_strings(spark):
    said = ["<turn user>", "</turn>\n", "<next>", "\\b\\l", "\\", "a\\", ">", "", "\n\n", "ünï \U0001f600<"]
    rows = [(1, i, "assistant" if i % 3 else "us<er>\\", t) for i, t in enumerate(said)]
    got = formatted(spark, rows)[1]
    assert [(t["role"], t["text"]) for t in got["turns"]] == [(r, t) for _, _, r, t in rows]
    assert got["loss"] == "".join(t for _, _, r, t in rows if r == "assistant")


@few
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", ""]), st.text(alphabet="\\blg<>/turnex \n", max_size=12)), min_size=1, max_size=12))
def test_chat_round_trip_random(spark, turns):
    got = formatted(spark, [(1, i, r, t) for i, (r, t) in enumerate(turns)])[1]
    assert [(t["role"], t["text"]) for t in got["turns"]] == turns
    assert got["loss"] == "".join(t for r, t in turns if r == "assistant")


def test_chat_merges_adjacent_roles(spark):
    got = formatted(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")])[1]
    assert got["formatted"] == "<turn user>a<next>b</turn>\n<turn assistant>c</turn>\n"
    assert [tuple(s) for s in got["loss_spans"]] == [(got["formatted"].index("c</"), got["formatted"].index("c</") + 1)]


def test_chat_nulls_ties_extra_columns_and_empty(spark):
    rows = [(None, 1, None, None, "x"), (None, 1, None, None, "x"), (2, 5, "user", "b", "x"), (2, 5, "user", "a", "x"), (2, None, "assistant", "z" * 100_000, "x")]
    got = formatted(spark, rows, TURNS + ", formatted string")
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", ""), ("", "")]
    assert [t["text"][:1] for t in got[2]["turns"]] == ["z", "a", "b"]
    assert formatted(spark, []) == {}


def test_chat_takes_time_by_length_only(spark):
    import time

    took = []
    for n in (4_000, 16_000):
        rows = spark.range(n).selectExpr("1 AS conv_id", "id AS turn", "if(id % 3 = 0, 'user', 'assistant') AS role", "concat('said <', id, '> \u00e9\U0001f600') AS text")
        made = chat.format_conversations(rows)
        start = time.perf_counter()
        got = made.select(F.length(chat.read_loss(F.col("formatted"), F.col("loss_spans"))).alias("n"), F.size("loss_spans").alias("s")).first()
        took.append(time.perf_counter() - start)
        assert got["n"] == sum(len(f"said <{i}> \u00e9\U0001f600") for i in range(n) if i % 3) and got["s"] == sum(1 for i in range(n) if i % 3)
    assert took[1] < 8 * took[0] + 2


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t", "a", "a b c d e " * 3, "x " * 40, "é" * 30 + " ü", "l\nl\nm\n l\n\n", "# * $ % & | < > ok", "a b c d e f a b c d e g a b c d x",
         " ".join(map(str, range(30_000))), "\u00a0 nbsp\u2003word", "THE!! LOUD!! WORDS!! " * 9]


def test_quality_measures_match_brute_force(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    got = quality.ledger(spark.createDataFrame(rows, DOCS)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in got} == {i: measures(t) for i, t in enumerate(TEXTS)}


@few
@given(st.lists(st.text(alphabet="ab \n#", max_size=60), min_size=1, max_size=6))
def test_quality_random(spark, texts):
    got = quality.ledger(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in got} == {i: measures(t)[4] for i, t in enumerate(texts)}


def test_quality_policies_and_ablation(spark):
    rows = [(1, "one two", "s"), (2, "x " * 40, "s"), (3, " ".join(f"w{i}" for i in range(20)), "s"), (4, "LOUD* " * 2, "s")]
    ledger = quality.ledger(spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", n_words int")).cache()
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(ledger, "v2").collect()}
    assert kept == {1: False, 2: False, 3: True, 4: False}
    by_rule = {r["rule"]: r for r in quality.ablation(ledger, "base").collect()}
    assert (by_rule["few_words"]["n_failed"], by_rule["few_words"]["n_failed_alone"], by_rule["few_words"]["n_kept"], by_rule["few_words"]["n_kept_without"]) == (2, 2, 1, 3)
    assert quality.ablation(quality.ledger(spark.createDataFrame([], DOCS)), "v1").count() == 0


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped = share * sum(sizes.values()), {}
    while True:
        free = {s for s in names if s not in capped}
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) >= most * sizes[s]}
        if not over:
            return capped | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        capped |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)


def test_mix_targets_and_copies(spark):
    rows = []
    for s, (source, n) in enumerate([("b", 300), ("a", 60), (None, 90), ("Z", 200), ("ä", 40), ("empty", 3)]):
        rows += [(1000 * s + i, "w " * (0 if source == "empty" else 1 + (i * 37 + s) % 90), source) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = targets(sizes)
    by_id = {i: (t, s) for i, t, s in rows}
    taken = Counter()
    for r in got:
        text, source = by_id[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (len(text.split()), sizes[source])
        assert r["target"] == pytest.approx(want[source], rel=1e-12)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[source] += r["taken"]
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= max(2, 0.002 * want[s]) for s in want)
    rates = {r["size"]: r["rate"] for r in got if by_id[r["doc_id"]][1] == "b"}
    tilt = {round(math.log(rate) / size, 9) for size, rate in rates.items() if rate < 2}
    assert len(tilt) == 1  # one exponential tilt for the source
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_mix_edge_cases(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None, None, 5), (1, None, None, 5), (2, "a b", "s", 5), (2, "a b", "s", 5), (None, "c", "s", 5)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS + ", rank int")).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == [(0, 1), (1, 0), (1, 0), (2, 2), (2, 2)]
    applied = mixing.apply_mix(spark.createDataFrame(rows, DOCS + ", rank int"))
    assert applied.columns == ["doc_id", "text", "source", "rank"] and applied.where("doc_id is null").count() == 1


def test_mix_hot_copies_share_copies(spark):
    rows = [(i, "same text here", "hot") for i in range(3000)] + [(9000 + i, "other words", "cold") for i in range(100)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), weights=(1, 1), share=1.0).collect()
    assert abs(sum(r["taken"] for r in got if r["doc_id"] < 9000) - got[0]["target" if got[0]["doc_id"] < 9000 else "target"]) >= 0
    hot = [r for r in got if r["doc_id"] < 9000]
    assert abs(sum(r["taken"] for r in hot) - hot[0]["target"]) <= 3


def judge_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if c.isascii() else c for c in host), path


RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
URLS = ["http://A.Example.ORG/es/1?x#y", "https://example.org/en/1", "http://example.org/en/2", "http://x.com/de/", "http://com/fr/", "http://xcom/de/", "http://notexample.org/es/",
        "org/", None, "", "http://", "x://y?z://w/org/", "http://a.org", "http://a.org#/", "http://ÄB.net/p", "http://u@h.co.uk:80/q", "http://a.b.com/de/x\ny"]


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, good int")
    for r in urls.judge_urls(pages, none, RULES).collect():
        host, path = judge_url(URLS[r["page_id"]])
        fits = [(len(rule), rule, v) for rule, v in RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])]
        want = max(fits, default=(0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *want[1:])
    assert urls.judge_urls(pages.limit(0), none, RULES).count() == 0


def test_host_reputation_shrinks_and_blocks(spark):
    bad = [("http://bad.spam.net/1", 0)] * 40 + [("http://good.fine.net/1", 1)] * 200 + [("http://new.spam.net/1", 0)]
    outcomes = spark.createDataFrame(bad + [("http://x.net/", None)], "url string, good int")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://bad.spam.net/z", "http://good.fine.net/z", "http://new.spam.net/z", "http://never.seen.io/"])], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge_urls(pages, outcomes, RULES).collect()}
    assert [got[i]["verdict"] for i in range(4)] == ["block", "allow", got[2]["verdict"], "allow"]
    assert got[0]["good_rate"] < got[2]["good_rate"] < got[3]["good_rate"] < got[1]["good_rate"]  # one bad page is shrunk to its domain


def test_host_without_outcomes_takes_its_domain_then_its_suffix(spark):
    rows = [(f"http://h{i}.spam.net/1", 0) for i in range(40) for _ in range(50)] + [("http://good.fine.org/1", 1)] * 3000
    outcomes = spark.createDataFrame(rows, "url string, good int")
    asked = ["http://new.spam.net/", "http://other.net/", "http://new.fine.org/", "http://never.seen.io/", None]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge_urls(pages, outcomes, RULES).collect()}
    overall = 3001 / 5002
    assert got[0]["verdict"] == "block" and got[0]["good_rate"] < got[1]["good_rate"] < overall < got[2]["good_rate"]
    assert got[3]["good_rate"] == pytest.approx(overall) and got[4]["good_rate"] == pytest.approx(overall)


def test_chat_digest_of_the_extra_conversation(spark, sf):
    from docmerge.llm.queries import op10_chat_format

    row = op10_chat_format(spark, sf).where("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


def brute_reputations(outcomes, second=("ac", "co", "com", "edu", "gov", "net", "org")):
    """(a, b) by host in plain Python: sums per level, a prior around the mean of the level above, its strength by moments."""

    def levels(host):
        labels = host.split("@")[-1].split(":")[0].split(".")
        double = len(labels) > 1 and labels[-2] in second and len(labels[-1]) == 2
        tail = 2 if double else 1
        return ".".join(labels[-tail:]), ".".join(labels[-tail - 1 :]), host

    total_k, total_n = sum(g for _, g in outcomes if g is not None), sum(g is not None for _, g in outcomes)
    prior_of = lambda key: (total_k + 1) / (total_n + 2)
    hosts = {h for h, _ in outcomes}
    for depth in (1, 2, 3):
        counts = {levels(h)[:depth]: [0, 0] for h in hosts}
        for h, good in outcomes:
            if good is not None:
                counts[levels(h)[:depth]][0] += good
                counts[levels(h)[:depth]][1] += 1
        expected = sum(n * prior_of(c[:-1]) * (1 - prior_of(c[:-1])) for c, (k, n) in counts.items())
        spread = sum((k - n * prior_of(c[:-1])) ** 2 for c, (k, n) in counts.items())
        extra = sum(n * (n - 1) * prior_of(c[:-1]) * (1 - prior_of(c[:-1])) for c, (k, n) in counts.items())
        correlation = (spread - expected) / extra if extra else None
        strength = 1000.0 if correlation is None or correlation <= 0 else min(1000.0, max(1.0, 1 / correlation - 1))
        found = {c: (k + strength * prior_of(c[:-1]), n - k + strength * (1 - prior_of(c[:-1]))) for c, (k, n) in counts.items()}
        means = {c: a / (a + b) for c, (a, b) in found.items()}
        prior_of = lambda key, means=means: means[key]
    return {c[-1]: ab for c, ab in found.items()}


def test_reputations_against_plain_python(spark):
    import random

    rng = random.Random(7)
    hosts = [f"{a}{d}" for a in ("", "www.", "x.y.") for d in ("example.com", "example.com.mx", "other.com.mx", "site.co.uk", "a.org", "b.de", "gov.uk", "com")] + ["", "u@h.net:80"]
    outcomes = [(h, rng.choice([0, 1, 1, None]) if "mx" not in h else rng.choice([0, 0, 0, 1])) for h in hosts for _ in range(rng.randrange(9))]
    want = brute_reputations([*outcomes, *((h, None) for h in hosts)])
    got = urls.reputations(spark.createDataFrame(outcomes, "host string, good int"), spark.createDataFrame([(h,) for h in hosts], "host string"))
    rows = {r["host"]: (r["a"], r["b"]) for r in got.collect()}
    assert set(rows) == set(want)
    for host, (a, b) in want.items():
        assert rows[host] == pytest.approx((a, b))
