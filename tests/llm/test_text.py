"""Quality rules, URL filters, chat, BPE and HTML: against brute force, the libraries, and on odd rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, html, quality, urls

ODD = [(1, None, "a"), (2, "", None), (2, "", None), (None, "x " * 4000, "b"), (3, "one two", None), (3, "one two", None)]


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with any output's."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return df.withColumns({"QUALITY": F.lit(1), "Ids": F.lit("i"), "tokens": F.lit(0), "judged": F.lit(2)})


def brute_repeats(text, w=5):
    ws = text.encode().split()
    n, longest = len(ws), 0
    count = Counter(tuple(ws[i : i + w]) for i in range(n - w + 1))
    inside = {j for i in range(n - w + 1) if count[tuple(ws[i : i + w])] > 1 for j in range(i, i + w)}
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and ws[i + k] == ws[j + k]:
                k += 1
            longest = max(longest, k if k >= w else 0)
    return n, len(inside), longest


def test_repeats_match_brute_force():
    random.seed(1)
    texts = [" ".join(random.choice("abc") for _ in range(random.randint(0, 60))) for _ in range(150)] + ["a " * 50, "", "x", "a b c d e " * 2]
    got = quality.repetition_stats(texts, quality.RepetitionRules())
    for i, t in enumerate(texts):
        assert (got["n_words"][i], got["n_repeat_words"][i], got["longest_repeat"][i]) == brute_repeats(t), t


def test_quality_counts():
    text = "# a b\n\n \na\u00a0é\x1c c\na b\n# a b\r\n# a b"
    got = {k: int(v[0]) for k, v in quality.repetition_stats([text], quality.RepetitionRules()).items()}
    assert (got["n_words"], got["n_symbols"], got["n_dup_lines"]) == (13, 3, 1)
    assert got["word_chars"] == sum(len(w.decode()) for w in text.encode().split())


def test_quality_on_odd_rows(odd):
    rows = quality.quality_rules(odd).select("doc_id", "source", "quality").collect()
    assert len(rows) == len(ODD) and not any(r.quality.kept for r in rows)
    assert [r.quality.n_words for r in rows if r.doc_id == 1] == [0]
    assert quality.quality_rules(odd.limit(0)).count() == 0


def test_quality_keeps_clean_and_rejects_repetitive(spark):
    words = [f"w{i}" for i in range(400)]
    passage = words[:150]
    docs = [(1, " ".join(words)), (2, "spam spam spam eggs " * 30), (3, " ".join([f"u{i}" for i in range(1500)] + passage + ["x"] + passage))]
    kept = {r.doc_id: r.quality.kept for r in quality.quality_rules(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {1: True, 2: False, 3: False}  # the third repeats too long a passage


def test_url_model_matches_brute_force(spark):
    seen = [("http://a.b/x", True), ("http://a.b/yy", True), ("http://c.d/é", False), ("http://c.d/x/x", False)]
    count = [Counter(), Counter()]
    for u, accepted in seen:
        p = urls.START + u + urls.END
        for i in range(len(p)):
            for k in range(1, urls.ORDER + 2):
                if i + k <= len(p) and p[i : i + k] != urls.START:
                    count[not accepted][p[i : i + k]] += 1
    context = [Counter(), Counter()]
    for c in (0, 1):
        for g, n in count[c].items():
            context[c][g[:-1]] += n

    def brute(url):
        p, total = urls.START + url + urls.END, 0.0
        for i in range(1, len(p)):
            pr = [1 / 256, 1 / 256]
            for k in range(urls.ORDER + 1):
                if i - k < 0:
                    break
                for c in (0, 1):
                    pr[c] = (count[c][p[i - k : i + 1]] + pr[c]) / (context[c][p[i - k : i]] + 1)
            total += math.log(pr[0] / pr[1])
        return total / (len(url) + 1)

    model = urls.fit(spark.createDataFrame(seen, "url string, accepted boolean"))
    asked = ["http://a.b/x", "http://c.d/q", "zzz", "http://a.d/xé", ""]
    got = {r.url: r.score for r in urls.score(spark.createDataFrame([(u,) for u in asked], "url string"), model).collect()}
    # scores lack a constant
    shift = {round(got[u] - brute(u), 4) for u in asked}
    assert max(shift) - min(shift) < 2e-4


def test_url_rules_and_odd_rows(spark):
    rows = [
        (1, None), (None, ""), (3, "x"), (4, "HTTP://A.COM/p?q"), (4, "HTTP://A.COM/p?q"), (5, "http://com/"), (6, "http://example.com/en/1"), (7, "http://www.example.com/en/1"), (8, "a://xnet/es/"),
        (9, "a://x.net/es/"), (10, "http://x.example.com/en/"), (11, "http://a.com"), (12, "http://B.net/fr/#x"), (13, "http://x.org/a://y.com/"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("Judged", F.lit(1))
    got = [(r.page_id, r.judged.host, r.judged.path, r.judged.rule, r.judged.verdict) for r in urls.url_filter(df).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g[1:] for g in got}
    assert by[1][:3] == ("", "", None) and by[4][:3] == ("a.com", "/p", "com/") and by[6][2:] == ("example.com/en/", "block") and by[7][2:] == ("www.example.com/en/", "allow")
    assert by[8][2] is None and by[9][2:] == ("net/es/", "block") and by[10][2] == "example.com/en/" and by[11][:3] == ("a.com", "", None) and by[12][:3] == ("b.net", "/fr/", "net/fr/") and by[13][0] == "x.org"
    assert urls.url_filter(df.limit(0)).count() == 0


def test_url_filter_learns(spark, tiny):
    got = urls.op2_url_filter(spark, tiny.replace("0.001", "0.01")).toPandas()
    assert set(got.verdict) == {"allow", "block"} and got[got.rule == "com/"].verdict.eq("allow").all()
    free = got[got.rule.isna()]
    assert free[free.host.str.endswith(".net")].verdict.eq("block").mean() > 0.7  # labelled URLs of that kind are rejected


def test_url_filter_learns_from_every_labelled_url(spark, monkeypatch):
    counted = {}
    for name in ("fit", "threshold"):
        monkeypatch.setattr(urls, name, lambda df, name=name, make=getattr(urls, name): counted.update({name: df.groupBy("accepted").count().collect()}) or make(df))
    pages = spark.range(10000).selectExpr("id AS page_id", "explode(array(concat('a://a.com/', id), concat('a://a.net/es/', id), concat('a://a.net/es/', id))) AS url")
    judged = urls.url_filter(pages.union(spark.createDataFrame([(-1, "a://a.org/es/7")], "page_id long, url string")))
    assert judged.count() == 30001
    total = Counter()
    for rows in counted.values():
        total.update({r.accepted: r["count"] for r in rows})
    assert total == {True: 10000, False: 10000} and all(len(rows) == 2 for rows in counted.values())


def test_url_weights_that_share_a_row_are_averaged_by_counts(spark, monkeypatch):
    """One row for all substrings: it holds the mean weight of an occurrence, which is small where both kinds are alike."""
    monkeypatch.setattr(urls, "BUCKETS", 1)
    seen = [(f"a://b/{'x' * (i % 7)}{i}", i % 2 == 0) for i in range(200)]
    rows = urls.fit(spark.createDataFrame(seen, "url string, accepted boolean")).collect()
    assert len(rows) == 1 and abs(rows[0].weight) < urls.SCALE


CHATS = [
    (1, 0, "user", "hi <|end|> \\<|body|>"), (1, 1, "assistant", "a\\"), (1, 2, "assistant", None), (1, 3, "user", ""), (2, 0, None, None), (None, 5, "assistant", "x"), (None, None, "as<|sistant", "<"),
    (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 1, "assistant", "é" * 50000), (4, 0, "system", "|<|>\n<\\|"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "extra": F.lit(None).cast("string")})
    out = chat.format_chat(df).withColumns({"back": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))})
    got = {r.conv_id: ([(t.role, t.text) for t in r.back], r.loss) for r in out.collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    want = {}
    for c in {r[0] for r in CHATS}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in CHATS if r[0] == c), key=order)]
        want[c] = (turns, "".join(t for role, t in turns if role == "assistant"))
    assert got == want
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_merges_turns_of_one_role(spark):
    df = spark.createDataFrame(CHATS[:4], "conv_id long, turn long, role string, text string")
    formatted = chat.format_chat(df).first().formatted
    assert formatted.count(chat.BLOCK) == 3 and formatted.count(chat.NEXT) == 1


@pytest.fixture(scope="module")
def coder():
    b = bpe.load(bpe.public_tokenizers.path(bpe.VOCABULARY))
    return b, tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=b.ranks, special_tokens={})


def test_bpe_is_the_library_s(coder):
    path = bpe.public_tokenizers.path(bpe.VOCABULARY)
    random.seed(0)
    letters = "abcdefghij THEthe 's\n\t  éüñß中文🙂 \u0085\x1c\x00123%%%$&\U00010ee7\u0301"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)] + ["a" * 3000, " " * 999 + "x", "\n" * 500, "é" * 1000, "<|endoftext|>", ""]
    for t in texts:
        assert coder[1].encode_ordinary(t) == bpe.encode_text(t, path).tolist(), t


def test_bpe_edits(coder):
    b = coder[0]
    random.seed(2)
    for _ in range(200):
        old = bytes(random.choice(b"abcdeth ") for _ in range(random.randint(0, 200)))
        last = b.extend(old, [-1])
        at = random.randint(0, len(old))
        gone, add = random.randint(0, min(5, len(old) - at)), bytes(random.choice(b"abcth") for _ in range(random.randint(0, 5)))
        new, table, _ = b.edited(old, last, at, gone, add)
        assert new == old[:at] + add + old[at + gone :] and table == b.extend(new, [-1]) and b.read(table) == b.merged(new)
    long = b"the cat sat on the mat " * 200
    assert b.edited(long, b.extend(long, [-1]), 100, 1, b"x")[2] < 200  # far from the edit nothing is computed again


def test_bpe_on_odd_rows(spark, odd):
    rows = bpe.round_trip(odd, out="tokens").collect()
    assert len(rows) == len(ODD) and all(bytes(r.tokens.decoded).decode() == (r.text or "") for r in rows)
    assert bpe.encode(odd.limit(0)).count() == 0
    ids = bpe.encode(odd, out="ids")
    assert [bytes(r.d).decode() for r in ids.select("text", bpe.decode(F.col("ids")).alias("d")).where("doc_id = 3").collect()] == ["one two"] * 2


def test_bpe_query(spark, tiny, coder):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").toPandas()
    got = bpe.op6_bpe(spark, tiny).toPandas().set_index("doc_id")
    for d in docs.itertuples():
        ids = coder[1].encode_ordinary(d.text)
        assert got.loc[d.doc_id].to_list() == [len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest()]


def test_html_blocks():
    page = "<html><head><title>t</title><style>p{}</style></head><body><script>x='</p>'</script><div class='ad box'>b &amp; c</div><p>one<br>two <b>three<p>four &lt;x&gt;<!-- no --> five\n six<ul><li>a<li>b</ul>&nbsp;</body> end <di"
    assert [(b[0][-1], b[1]) for b in html.blocks(page)] == [(".box", "b & c"), ("p", "one two three"), ("p", "four <x> five six"), ("li", "a"), ("li", "b"), ("html", "end")]
    assert html.blocks("") == [] and html.blocks("<p") == [] and html.blocks("x")[0][1] == "x"


def test_html_blocks_of_deep_pages_in_linear_time():
    import time

    def took(n):
        page = "".join(f"<div class='a b'>text {i}" for i in range(n)) + "<a>link " * 50 + "</p></li>" * n
        began = time.process_time()
        found = html.blocks(page)
        assert [b[1] for b in found[:3]] == ["text 0", "text 1", "text 2"] and len(found) == n and max(len(b[0]) for b in found) <= 3 * html.DEPTH
        return time.process_time() - began

    took(500)
    assert took(20000) < 12 * max(took(4000), 0.02)
    wide = html.blocks("<p class='" + "x " * 50000 + "'>one<p>two")
    assert [b[1] for b in wide] == ["one", "two"] and len(wide[0][0]) <= html.NAMES + 1


def test_html_labels_held_out_pages():
    labeller, features, wrong, total = html.trained(), html.Features(), 0, 0
    for seed in range(500_000, 500_200):
        page, kept = html.generated(seed)
        own = html.blocks(page)
        want = np.array([b[1] in kept for b in own])
        wrong += int((labeller.label([features.of(own)])[0] != want).sum())
        total += len(want)
    assert wrong <= total * 0.002


def test_html_gradient_is_the_loss_s_slope():
    features = html.Features()
    pages, labels = [], []
    for seed in (1, 2):
        page, kept = html.generated(seed)
        own = html.blocks(page)
        pages.append(features.of(own))
        labels.append(np.array([b[1] in kept for b in own], np.float32))
    m = html.Labeller()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}

    def loss():
        s = m.scores(pages)
        return sum(np.logaddexp(0, np.where(y > 0, -1, 1) * s[: len(y), j]).sum() for j, y in enumerate(labels)) / sum(map(len, labels))

    g = m.gradient(pages, labels)
    for k in ("wf", "wb", "bf", "out", "embed"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        m.p[k][at] += 1e-3
        up = loss()
        m.p[k][at] -= 2e-3
        slope = (up - loss()) / 2e-3
        m.p[k][at] += 1e-3
        assert abs(slope - g[k][at]) < 2e-3 * max(1, abs(slope)) + 1e-4, k


def test_html_query_and_odd_rows(spark, tiny):
    import re
    from html import unescape

    def want(page):
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page, re.S)[1]
        parts = (" ".join(unescape(re.sub("</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        return "\n".join(x for x in parts if x)

    pages = spark.read.parquet(f"{tiny}/pages.parquet").toPandas().set_index("page_id")
    for r in html.op7_html(spark, tiny).collect():
        assert r.text == want(pages.loc[r.page_id].html) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "<article><p>" + "word " * 30000)], "page_id long, html string").withColumn("TEXT", F.lit(0))
    got = [(r.page_id, len(r.text)) for r in html.extract(odd).collect()]
    assert got == [(1, 0), (2, 0), (2, 0), (None, 149999)]
    assert html.extract(odd.limit(0)).count() == 0
