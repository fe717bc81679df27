"""Operators 3, 6, 7, 9 and 10, and 4 on a planted corpus."""

import hashlib
import random
import re
import tarfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyarrow import fs

from lodestone.llm import chat, html_text, language, media, quality, toxicity
from tests.llm.conftest import ODD

# chat


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice("\\[]<>()/{}sINST \n") for _ in range(rng.randrange(20)))
        assert chat.unescape(chat.escape(t)) == t and not set(chat.escape(t)) & set("[]<>")
        assert chat.parse(chat.instruct([("user", t), (t, t), ("assistant", t)])) == [("user", t), (t if t not in ("user", "assistant") else t, t), ("assistant", t)]


def test_rewritten_history_is_found():
    def last_whole(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 else t.strip()}<end>" for i, (r, t) in enumerate(turns))

    seen = chat.Incremental(last_whole, None)
    assert seen.add("user", "a") == ("<user>a<end>", 6, 7) and not seen.rewritten
    seen.add("assistant", " b ")
    seen.add("user", "c")
    assert seen.rewritten
    wrong = chat.Incremental(lambda turns: "".join(f"{len(turns)}:{t};" for _, t in turns), 0)  # says that it needs no context
    wrong.add("user", "a")
    wrong.add("user", "b")
    assert wrong.rewritten


def test_formatted(spark):
    rows = [(1, 0, "system", "s"), (1, 2, "assistant", "</s>[INST] ok"), (1, 1, "user", None), (2, 0, "assistant", "é🙂"), (2, 0, "assistant", "é🙂"), (3, 0, None, "x"), (None, 0, "user", "y")]
    turns = spark.createDataFrame([(*r, 9, "p") for r in rows], "conv_id long, turn long, role string, text string, loss int, piece string")
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(turns)).collect()}
    by: dict = {}
    for c, _, r, t in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", t or ""))
    for c, ts in by.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        want = (c, len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.instruct(ts)), False)
        assert tuple(got[c]) == want
    assert chat.digests(chat.formatted(turns.limit(0))).collect() == []
    many = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    assert chat.digests(chat.formatted(many, context=2)).first()["n_turns"] == 3000


# media


def test_media(odd, none, spark):
    rows, root = media.store(odd)
    places = media.canonical(rows)
    got = sorted((tuple(r)[:7] for r in media.media_columns(odd).collect()), key=str)
    want = []
    for d, t in ODD:
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        image = media.encode_image(payload)
        assert media.decode_image(image) == payload
        want.append((d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest()))
    assert got == sorted(want, key=str)
    assert {bytes(r["digest"]).hex(): r["height"] for r in media.metadata(places, root).collect()} == {w[3]: w[2] // 576 for w in want}
    at = places.first()
    system, base = fs.FileSystem.from_uri(root)
    with tarfile.open(f"{base}/{at['shard']}") as shard:
        assert bytes(at["digest"]).hex() + ".png" in shard.getnames()
    assert media.media_columns(none).collect() == []


# language

SAID = {"en": "the cat and the dog were in that house with their friends", "de": "der hund und die katze waren nicht in dem großen haus", "ru": "кошка и собака были в доме вместе со своими друзьями"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = rng.integers(0, 30, 6)
        s = rng.integers(-8, 1, (int(lengths.sum()), 3)).astype(np.float32)
        got, at = language.viterbi(s, lengths, 5.0, int(rng.integers(1, 9))), 0
        for n in lengths.tolist():
            e, path = s[at : at + n], got[at : at + n]
            v = np.zeros(3)
            for t in range(n):
                v = np.maximum(v, v.max() - 5) + e[t]
            if n:
                assert e[np.arange(n), path].sum() - 5 * (np.diff(path) != 0).sum() == pytest.approx(v.max())
            at += n


def test_language(spark, odd, none):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.sample(SAID[k].split(), 8)), k) for i, k in enumerate(list(SAID) * 40)]
    model = language.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert model["names"] == ["de", "en", "ru"]
    mixed = f"{SAID['en']} {SAID['en']} {SAID['de']}"
    asked = spark.createDataFrame([(1, SAID["de"]), (2, SAID["en"]), (3, SAID["ru"]), (4, mixed), (5, "12 !"), (6, None), (7, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(asked, model, spans=True).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 8)] == ["de", "en", "ru", "en", "und", "und", "und"] and got[5]["score"] == 0
    assert [s["lang"] for s in got[4]["spans"]] == ["en", "de"] and got[4]["spans"][1]["first"] == 24 and 0.5 < got[4]["score"] < 0.8
    assert language.identify(odd, model).count() == len(ODD) and all(0 <= r["score"] <= 1 for r in language.identify(odd, model).collect())
    unlearned = language.train(none)
    assert {r["lang_pred"] for r in language.identify(odd, unlearned).collect()} == {"und"} and language.identify(none, model).collect() == []


# quality


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd, none):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n#|é\t") for _ in range(rng.randrange(80))) for _ in range(200)] + [t or "" for _, t in ODD]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in quality.judge(df).collect():
        n, *_, repeated = want = counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.BASE) == want
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n) and not (r["base_failed"] and r["kept"])
    assert quality.judge(odd).count() == len(ODD) and quality.judge(none).collect() == []


def test_expectation_maximisation_against_a_plain_one(spark):
    rng, names = random.Random(6), ["a", "b", "c"]
    rows = []
    for _ in range(400):
        y = rng.random() < 0.8
        rows.append(tuple((0 if rng.random() < 0.2 else (1 if y else -1) * (1 if rng.random() < acc else -1)) for acc in (0.95, 0.9, 0.7)))
    got = quality.estimate(spark.createDataFrame(rows, "a int, b int, c int"), names)
    p = {"share": quality.START_SHARE} | {f"good_{v}": quality.START_GOOD for v in names} | {f"bad_{v}": quality.START_BAD for v in names}
    for _ in range(quality.ROUNDS):
        g = []
        for r in rows:
            good, bad = p["share"], 1 - p["share"]
            for v, x in zip(names, r):
                good *= 1 if x == 0 else p[f"good_{v}"] if x == 1 else 1 - p[f"good_{v}"]
                bad *= 1 if x == 0 else p[f"bad_{v}"] if x == -1 else 1 - p[f"bad_{v}"]
            g.append(good / (good + bad))
        w, new = quality.WEIGHT, {}
        new["share"] = min(max((sum(g) + w * quality.START_SHARE) / (len(rows) + w), 0.5), 0.98)
        for k, v in enumerate(names):
            new[f"good_{v}"] = (sum(x for x, r in zip(g, rows) if r[k] == 1) + w * quality.START_GOOD) / (sum(x for x, r in zip(g, rows) if r[k]) + w)
            new[f"bad_{v}"] = (sum(1 - x for x, r in zip(g, rows) if r[k] == -1) + w * quality.START_BAD) / (sum(1 - x for x, r in zip(g, rows) if r[k]) + w)
        p = {k: v if k == "share" else min(max(v, 1e-4), 1 - 1e-4) for k, v in new.items()}
    assert got == pytest.approx(p)


def test_quality_verdicts(spark):
    rng = random.Random(2)
    clean = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(90)) for _ in range(80)]
    junk = [" ".join(f"{w}%%%" for w in t.split()) for t in clean[:15]]
    df = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.judge(df).filter("kept").collect()}
    assert kept == set(range(80))


# pages

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><p>Tagline of the site</p></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, and this sentence is as long as a paragraph of text might be.</div><!-- <p>no</p> -->
<article class="post"><header><h1>Title &amp; more</h1></header><p>First <a href=y>link</a>
 text.<p>To.<script>var a="</p>"</script><div class="ad">Buy now and save a lot of money on all these things.</div><ul><li>One<li>Two</ul><form><p>Your mail</p><input></form>
<aside>Aside</aside><section class="comments"><h2>Comments</h2><p>I disagree strongly with all of this.</p></section></article><div id="sidebar"><p>Other articles to read on this site today.</p></div><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst link text.\n\nTo.\n\nOne\n\nTwo"
    plain = "<body><div><a href=a>Home</a> <a href=b>News</a></div><h1>A title of a page</h1><div>" + "word " * 60 + "</div><div>" + "more " * 40 + "</div><div><a href=c>Next page here</a></div></body>"
    assert html_text.main_text(plain).startswith("A title of a page\n\nword word") and "Next" not in html_text.main_text(plain) and "Home" not in html_text.main_text(plain)


@pytest.mark.parametrize("html", [None, "", " ", "<", "a<b", "<p", "<div class='x", "</p></p>", "<!--", "<script>", "<article>" * 50, "&#xZZ; &bogus; &amp;" * 3, "<a>" * 5000])
def test_broken_pages(html):
    assert isinstance(html_text.main_text(html), str)


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "<article>" + "<p>w</p>" * 19_999, "t")], "page_id long, url string, html string, text string")
    rows = html_text.extract(df).collect()
    assert sorted((str(r["page_id"]), r["url"], r["n_chars"]) for r in rows if r["url"]) == [("1", "u", 45), ("1", "u", 45), ("None", "v", 3 * 19_999 - 2)]
    assert [r["text"] for r in rows if r["url"] is None] == [""] and html_text.extract(df.limit(0)).collect() == []


# toxicity


def planted(rng, n, bad):
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ",", "!"]))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity(spark, odd, none):
    rows = planted(random.Random(3), 900, ["zounds", "yuckword", "xylvile"])
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 1) for r in rows] + [(5000, 1, 0), (7, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {d for d, r in got.items() if r["held_out"]} == {r[0] for r in held}
    assert np.mean([got[d]["predicted"] == y for d, _, y in held]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, model).collect()) and toxicity.score(none, model).collect() == []
    assert toxicity.train(docs, labels.filter("toxic = 0")) is None and {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}


def test_pooling_is_the_plain_convolution():
    rng = np.random.default_rng(2)
    numbers = [np.arange(1, n + 1) for n in (0, 1, 2, 9)]
    rows, lengths = toxicity._padded(numbers)
    table = rng.normal(size=(10, toxicity.TAPS)).astype(np.float32)
    table[0] = 0
    pooled, _, _ = toxicity.responses(table[rows], lengths)
    for d, n in enumerate(numbers):
        words = [table[i] for i in n] or [table[0]]
        words += [table[0]] * 2
        at, column = 0, 0
        for width, f in toxicity.FILTERS:
            best = np.max([sum(words[i + t][at + t * f : at + (t + 1) * f] for t in range(width)) for i in range(max(1, len(n)))], axis=0)
            assert pooled[d, column : column + f] == pytest.approx(best, abs=1e-5)
            at, column = at + width * f, column + f
