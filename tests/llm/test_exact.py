"""Operators that are tested against brute force or an exact round trip."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagewright.llm import chat, decontaminate, extract, fingerprint, packing, tokens

MODEL = public_tokenizers.path(tokens.MODEL)


# --- token counts


@pytest.mark.parametrize("alphabet", ["ab  c\n", "abcdefgh é€  .,", "    ▁x y", "the of and ing \t", "中文 \U0001f600 a<s></s>", " ", "é", "abcdefg"])
def test_spliced_counts_equal_whole_counts(alphabet):
    rng = random.Random(alphabet)
    whole = tokens.counter(MODEL)
    for chunk, overlap in ((5, 2), (20, 5), (60, 16)):
        small = tokens.counter(MODEL, chunk, overlap)
        for _ in range(40):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300)))
            assert small.count_huge(text) == len(whole.model.encode(text)), text


@pytest.mark.parametrize("alphabet", ["中文字符的一是在", "abc", "xq", "한국어", "ab,.;", "a"])
def test_texts_without_spaces_are_spliced(alphabet):
    rng = random.Random(alphabet)
    text = "".join(rng.choice(alphabet) for _ in range(20_000))
    huge = tokens.counter(MODEL, 500, 64)
    at = time.process_time()
    assert huge.count_huge(text) == len(huge.model.encode(text))
    assert time.process_time() - at < 5


def test_token_counts(spark):
    texts = [None, "", "hello world", "hello world", "<s> x </s>", "long words " * 30_000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    out = {r.doc_id: r for r in tokens.token_counts(docs, MODEL).collect()}
    model = tokens.counter(MODEL).model
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (out[i].n_tokens, out[i].n_bytes, out[i].over_limit) == (n, len((t or "").encode()), n > 4096)
    assert tokens.token_counts(docs.limit(0), MODEL).count() == 0


# --- packing


def pack(docs, **kw):
    path = public_tokenizers.path
    return packing.packed(docs, path(packing.TOKENIZER), path(packing.RANKS), public_tokenizers.PATTERN, **kw)


def test_equal_rows_are_sampled_like_others(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(packing, "Tree", lambda rows, idf, share, shard: taken.append((len(rows), share)))
    equal = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(7).cast("long").alias("ids_crc32"), F.encode(F.lit("ab"), "UTF-8").alias("ids"), F.col("id").alias("nth"))
    packing.grown(equal, np.zeros(1 << 16), 200_000, 4000)
    (rows, share), = taken
    assert share == pytest.approx(0.02) and 0.8 < rows / (share * 20_000) < 1.2


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("al", "on", "ik", "é")]
    texts = [None, "", "a <|endoftext|> b", "same text", "same text", "word " * 3000] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(120)]
    rows = [(i if i != 4 else 3, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    tool = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    out = pack(docs, shard=40).toPandas()
    for doc_id, text, _ in rows:
        own = out[out.doc_id == doc_id].sort_values(["start", "length"])
        ids = tool.encode(text or "", add_special_tokens=False).ids + [0]
        if doc_id == 3:  # two rows of one id: each id twice
            assert own.length.sum() == 2 * len(ids)
            continue
        at = 0
        for p in own.itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    sizes = []
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert list(seq.offset) == [0, *np.cumsum(seq.length)[:-1]]
        sizes.append(seq.length.sum())
    assert max(sizes) <= 1024 and sum(s < 1024 for s in sizes) <= 120 // 40 + 2
    assert pack(docs.limit(0)).count() == 0


def test_ids_are_the_librarys():
    """Random texts over every class of characters, white space and the special strings, whole and in segments."""
    import sys
    import unicodedata

    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    own = packing.encoder(public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS), public_tokenizers.PATTERN)
    rng = random.Random(12)
    classes = {}
    for x in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(x))
        if kind not in ("Cs", "Cn"):
            classes.setdefault(kind, []).append(chr(x))
    parts = ["'s", "'ll", "'", "  ", "\n\n", "\t", "\r\n", "\u3000", *own.special, "the", " quick", "1234", "a1", "_", "\u0301"]
    kinds = sorted(classes)
    for _ in range(3000):
        text = "".join(rng.choice(parts) if rng.random() < 0.3 else rng.choice(classes[rng.choice(kinds)]) for _ in range(rng.randint(0, 40)))
        expected = tool.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == expected, text
        assert [i for x in packing.segments(text, rng.randint(1, 9)) for i in own.encode(x)] == expected, text
    prose = " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) + rng.choice(["", ",", "'s", " 12", "\n"]) for _ in range(400))
    parts_ = list(packing.segments(prose, 50))
    assert len(parts_) > 20 and "".join(parts_) == prose
    assert [i for x in parts_ for i in own.encode(x)] == tool.encode(prose, add_special_tokens=False).ids


def test_bm25_scores_against_brute_force():
    rng = np.random.default_rng(4)
    items = [rng.integers(1, 60, rng.integers(1, 50)).astype("<u2") for _ in range(50)]
    df = [sum(t in x for x in items) for t in range(60)]
    idf = np.zeros(1 << 16)
    idf[:60] = [np.log1p((50 - d + 0.5) / (d + 0.5)) for d in df]
    mean = np.mean([len(x) for x in items])
    index = packing.Index(items, idf, mean)

    def weight(t, x):
        tf = np.sum(x == t)
        return idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))

    for seed, x in enumerate(items):
        terms = sorted(set(x.tolist()), key=lambda t: -weight(t, x))[: packing.TERMS]
        near, score = index.neighbours(seed)
        assert [weight(t, x) for t in index.query[seed]] == pytest.approx([weight(t, x) for t in terms])
        brute = {i: sum(weight(t, y) for t in index.query[seed]) for i, y in enumerate(items)}
        assert dict(zip(near.tolist(), score.tolist(), strict=True)) == pytest.approx({i: v for i, v in brute.items() if v > 0})


def test_a_seed_takes_its_neighbours_first():
    rng = np.random.default_rng(1)
    topics = [np.arange(k * 100 + 1, k * 100 + 60, dtype="<u2") for k in range(4)]
    items = [rng.choice(topics[i % 4], 200).astype("<u2") for i in range(40)]
    df = np.zeros(1 << 16)
    for x in items:
        df[np.unique(x)] += 1
    pieces = packing.fill(items, np.log1p((40 - df + 0.5) / (df + 0.5)), 200.0)
    by = {}
    for item, _, _, sequence, _ in pieces:
        by.setdefault(sequence, []).append(item % 4)
    same = [len(set(t)) == 1 for t in by.values()]
    assert np.mean(same) > 0.6


def test_neighbours_meet_in_shards():
    rng = np.random.default_rng(3)
    topics = [rng.choice(np.arange(1, 20_000, dtype="<u2"), 80, replace=False) for _ in range(40)]
    common = np.arange(30_000, 30_040, dtype="<u2")
    items = [np.concatenate([rng.choice(topics[i % 40], 60), rng.choice(common, 60)]).astype("<u2") for i in range(1600)]
    df = np.zeros(1 << 16)
    for x in items:
        df[np.unique(x)] += 1
    idf = np.log1p((1600 - df + 0.5) / (df + 0.5))
    index, hashes = packing.Index(items, idf, 120.0), rng.integers(0, 1 << 30, 1600)
    for shard in (400, 100, 50):
        own = packing.Tree(items, idf, 1.0, shard).shards(items, hashes)
        assert np.bincount(own).max() <= 3 * shard and own.max() + 1 >= 1600 // shard // 2
        met = []
        for seed in range(0, 1600, 40):
            near, score = index.neighbours(seed + seed // 40)
            best = near[np.argsort(-score, kind="stable")[1:9]]
            met.append(np.mean(own[best] == own[seed + seed // 40]))
        assert np.mean(met) > 0.6  # by a hash: shard / 1600
    copies = packing.Tree([items[0]] * 1000, idf, 1.0, 100).shards([items[0]] * 1000, hashes[:1000])
    assert np.bincount(copies).max() < 200


def test_neighbours_beyond_the_best_are_tried():
    rng = np.random.default_rng(2)
    near = [np.full(5, 7, "<u2") for _ in range(150)]
    far = [np.arange(100 + 20 * i, 120 + 20 * i).astype("<u2") for i in range(60)]
    items = [np.append(np.full(599, 7), 8).astype("<u2"), *near, *far]
    idf = rng.uniform(1, 1.1, 1 << 16)
    pieces = packing.fill(items, idf, 50.0)
    first = {item for item, _, _, sequence, _ in pieces if sequence == 0}
    assert len(first & set(range(1, 151))) == 85


# --- fingerprints


def lanes(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    out = fingerprint.fingerprints(rows, ("id",), {"x": "t"}).orderBy("id").collect()
    return [(r.x_strong, r.x_sketch) for r in out]


def test_multiset_hash_ignores_order_and_adds_up(spark):
    a, b, both, swapped, twice, once = lanes(spark, "first line here.", "second one. is there", "first line here.\nsecond one. is there", "second one. is there\nfirst line here.", "x\nx", "x")
    assert both == swapped and twice != once
    mod = lambda x, y, sign: ([(p + sign * q) % 2**32 for p, q in zip(x[0], y[0])], [(p + sign * q) % 2**16 for p, q in zip(x[1], y[1])])
    assert mod(a, b, 1) == both and mod(both, b, -1) == a


def test_likeness_of_a_text_that_repeats_one_phrase(spark):
    docs = spark.createDataFrame([(1, "a " * 100_000), (2, "b. c. " * 40_000)], "doc_id long, text string")
    out = fingerprint.edited_fingerprints(docs).where("doc_id = 1").first()
    assert out.near_edited > 0.5  # three quarters are equal


@pytest.mark.parametrize("alphabet", ["".join(map(chr, range(0x4E00, 0x9E00, 26))), "абвгдежзиклмнопр   ", "مرحبابالعالمكيفحالك   ", "abcdefghijk   "])
def test_likeness_in_other_scripts(spark, alphabet):
    rng = random.Random(alphabet)
    text = lambda: "".join(rng.choice(alphabet) for _ in range(1500))
    docs = spark.createDataFrame([(i, text()) for i in range(12)], "doc_id long, text string")
    out = fingerprint.edited_fingerprints(docs).collect()
    assert np.mean([r.near_edited for r in out]) > 0.4 and np.mean([r.near_next for r in out]) < 0.25


def test_clumped_ids_make_even_buckets(spark):
    rows = [(10**12 + i, "") for i in range(3000)] + [(i * 10**9, "") for i in range(3000)]
    found, _ = fingerprint.bucketed(spark.createDataFrame(rows, "doc_id long, text string"))
    found = found.toPandas().sort_values("doc_id")
    assert found["bucket"].is_monotonic_increasing and found.groupby("bucket").size().max() <= 190


def test_edited_fingerprints(spark):
    rng = random.Random(8)
    text = lambda n: "\n".join(" ".join(rng.choice("an of river stone is under table on walk eat").__str__() + rng.choice("abcde") for _ in range(9)) + "." for _ in range(n))
    rows = [(i * 7 % 101, text(rng.randint(20, 40)), "clash") for i in range(60)] + [(200, None, ""), (201, "", ""), (202, "é\U0001f600xyz", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    out = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    order = sorted(rows)
    for i, (doc_id, t, _) in enumerate(order):
        own, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(own) // 4
        r = out[doc_id]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256((own[: len(own) - k] + nxt[:k]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert out[200].fingerprint == out[201].fingerprint == out[201].edited_fingerprint and out[200].near_next == 1
    assert np.mean([r.near_edited > r.near_next for r in out.values() if r.n_chars > 100]) > 0.95
    assert fingerprint.edited_fingerprints(docs.limit(0)).count() == 0
    alone = fingerprint.edited_fingerprints(docs.where("doc_id = 202")).first()
    assert alone.near_next == 1


def test_buckets_do_not_change_the_next_row(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 3)
    rows = [(i * i, f"text {i}") for i in range(50)] + [(49, "twin"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, buckets = fingerprint.bucketed(docs)
    out = fingerprint.with_next(found, "text", "text", "next", buckets).collect()
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    assert {(r.text, r.next) for r in out} == {(t, order[(i + 1) % len(order)]) for i, t in enumerate(order)}


# --- chat


def test_escapes_are_reversible(spark):
    rng = random.Random(5)
    parts = ["<", "[", "~", "|im_start|>", "|im_end|>", "s>", "/s>", "INST]", "/INST]", "\n", "a", "\\", "n", "<|im_end|>\n"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))),) for _ in range(600)]
    df = spark.createDataFrame(rows, "t string")
    out = df.select("t", chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r"), chat.escape(F.col("t")).alias("e")).collect()
    assert all(r.t == r.u == r.r for r in out)
    assert not any(c in r.e for r in out for c in ("<|im_end|>", "<|im_start|>", "</s>", "[INST]"))


def test_reply_trees(spark):
    rows = [  # a tree with three leaves, a chain, a cycle, and an orphan whose parent isn't there
        (1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a", 0.2), (1, 3, 1, "assistant", "b", 0.9), (1, 4, 3, "user", "c", None), (1, 5, 3, "user", "d", 0.5),
        (3, 1, 2, "user", "x", 1.0), (3, 2, 1, "user", "y", 1.0), (4, 7, 99, "user", "z", 1.0),
    ] + [(2, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(13)]
    df = spark.createDataFrame(rows, "conv_id long, message_id long, parent_id long, role string, text string, score double")
    every = chat.formatted(chat.best_paths(df), df).select("conv_id", "leaf", chat.parsed(F.col("formatted")).alias("t")).collect()
    found = {(r.conv_id, r.leaf): "".join(x.text for x in r.t) for r in every}
    assert found == {(1, 2): "qa", (1, 4): "qbc", (1, 5): "qbd", (2, 12): "0123456789101112", (4, 7): "z"}
    best = {(r.conv_id, r.leaf) for r in chat.best_paths(df, 1).collect()}
    assert best == {(1, 5), (2, 12), (4, 7)}


def test_digests(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>\n"), (1, 1, "assistant", "<|im_end|>\n"), (2, None, None, ""), (None, 1, "user", "lost")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, leaf string")
    out = {r.conv_id: r for r in chat.digests(df).collect()}
    assert set(out) == {1, 2}
    assert out[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\n<|im_end|>\n\nassistant\n<|im_end|>\n\n").hexdigest()
    assert (out[1].n_turns, out[1].loss_chars, out[2].n_turns, out[2].loss_chars) == (3, 22, 1, 0)
    assert chat.digests(df.limit(0)).count() == 0


# --- pages


def brute_cut(gain, edges):
    best = None
    for mask in range(1 << len(gain)):
        x = [bool(mask >> i & 1) for i in range(len(gain))]
        cost = sum(abs(g) for g, v in zip(gain, x, strict=True) if (g > 0) != v and g) + sum(w for (a, b), w in edges.items() if x[a] != x[b])
        best = cost if best is None else min(best, cost)
    return best


def test_minimum_cut():
    rng = random.Random(7)
    for _ in range(150):
        n = rng.randint(1, 9)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4}
        x = extract.min_cut(gain, edges)
        cost = sum(abs(g) for g, v in zip(gain, x, strict=True) if (g > 0) != v) + sum(w for (a, b), w in edges.items() if x[a] != x[b])
        assert cost == pytest.approx(brute_cut(gain, edges))


def test_main_text(spark):
    page = (
        "<html><head><title>no</title></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class='cookie-notice'>We set cookies, of course.</div>"
        "<article><h1>Head</h1><p>Body &amp; soul &lt;b&gt; is here,\n with words.<p>wor<b>d</b>&nbsp;two<script>no()</script><div class=ad>Buy this now.</div>"
        "<section id='comments'><p>I liked it very much, well done.</p></section></article><footer>&copy; us</footer>"
    )
    rows = [(1, "u", page, "clash"), (2, None, None, ""), (3, "u", "", ""), (3, "u", "", ""), (4, "u", "<p" * 50_000, ""), (5, "u", "<div>" * 3000 + "deep", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract.extraction(pages).collect()
    found = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and found[1] == "Head Body & soul <b> is here, with words. word two" and found[2] == found[3] == ""
    assert all(r.n_chars == len(r.text) for r in out)
    assert extract.extraction(pages.limit(0)).count() == 0


def labelled_pages(rng, n):
    """Pages as lists of (markup before, text, markup after, content or not): half mark nothing, a third are wrapped in one form."""
    sentence = lambda: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(14, 40))).capitalize() + "."
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randint(2, 7))).capitalize()
    for i in range(n):
        marked, wrapped = i % 2 == 1, i % 3 == 0
        tag = lambda name: name if marked else "div"  # noqa: E731, B023
        menu = [(f"<{tag('nav')}><ul>" * (k == 0) + '<li><a href="/">', word(), "</a></li>" + f"</ul></{tag('nav')}>" * (k == 4), False) for k in range(5)]
        body = [("<h1>", word() + " " + word(), "</h1>", True)]
        body += [("<p>", word() if rng.random() < 0.25 else sentence(), "</p>", True) for _ in range(rng.randint(6, 12))]
        if marked:
            body.insert(4, ('<div class="ad">', sentence(), "</div>", False))
        foot = [(f"<{tag('footer')}>", "© " + word() + " 2024", f"</{tag('footer')}>", False)]
        first, *rest = body
        *rest, final = rest
        body = [("<div>" + first[0], *first[1:]), *rest, (*final[:2], final[2] + "</div>", final[3])]
        yield [("<form>" * wrapped, "", "", None), *menu, *body, *foot, ("", "", "</form>" * wrapped, None)]


def test_the_cut_is_better_than_its_parts():
    """Errors of the cut, of each block's own sign, and of the rule that takes all but what the markup names as boilerplate."""
    weights = extract.fit(np.zeros((0, len(extract.PRIOR))), np.zeros(0))
    total, wrong = 0, {"cut": 0, "own sign": 0, "tags": 0}
    changed = 0
    for parts in labelled_pages(random.Random(5), 120):
        found = extract.blocks("".join(a + t + b for a, t, b, _ in parts))
        truth = [c for _, t, _, c in parts if t]
        assert len(found) == len(truth)
        gain, edges = extract.graph(found, weights)
        cut = extract.min_cut(gain, edges)[: len(found)]
        sign = [g > 0 for g in gain[: len(found)]]
        tags = [b.element.region is None or b.element.region.cue > 0 for b, _ in found]
        total += len(truth)
        changed += sum(c != s for c, s in zip(cut, sign, strict=True))
        for name, own in (("cut", cut), ("own sign", sign), ("tags", tags)):
            wrong[name] += sum(a != b for a, b in zip(own, truth, strict=True))
    assert changed > 0.05 * total
    assert wrong["cut"] < 0.5 * wrong["own sign"] and wrong["cut"] < 0.2 * wrong["tags"] and wrong["cut"] < 0.05 * total, (total, wrong)


@pytest.mark.parametrize("piece", ["<a x", '<a x="', "<div>", "<div><p>x</p>", "<p>ab</p>", "<p>one two three four five six seven eight nine ten.</p>", "<nav>", "</p>"])
def test_hostile_pages_take_linear_time(piece):
    weights = extract.fit(np.zeros((0, len(extract.PRIOR))), np.zeros(0))

    def seconds(n):
        at = time.process_time()
        extract.extract(piece * (n // len(piece)) + "\"", weights)
        return time.process_time() - at

    assert seconds(1 << 20) < max(1.0, 40 * min(seconds(1 << 16), seconds(1 << 16)))


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p data-x=it's>Hello, don't stop here.</p></article>", "Hello, don't stop here."),
        ("""<article><p title='a "quoted" > b'>x y</p></article>""", "x y"),
        ('<article><p>seen</p><p title="never closed>lost</p></article>', "seen"),
        ("<form><header><a>x</a></header><article><p>In a form.</p><aside>no</aside></article></form>", "In a form."),
        ("<article><p>a &lt;b&gt; c<br>d</p><section class='commentList'><div><p>Nice and long, and well said by all of you who came along today.</p></div></section></article>", "a <b> c d"),
    ],
)
def test_markup_of_pages(page, text):
    assert extract.extract(page, extract.fit(np.zeros((0, len(extract.PRIOR))), np.zeros(0))) == text


# --- decontamination


def brute_distance(item, text):
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (a != b)))
        prev = row
    return min(prev)


def edit(rng, s, k):
    s = list(s)
    for _ in range(k):
        p, o = rng.randrange(len(s)), rng.random()
        if o < 0.34:
            s[p] = rng.choice("abcdefghij ")
        elif o < 0.67:
            del s[p]
        else:
            s.insert(p, rng.choice("abcdefghij "))
    return "".join(s)


def test_infix_distance():
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 12)))
        b = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 30)))
        assert decontaminate.infix_distance(a, b)[0] == brute_distance(a, b)


def test_contaminated(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(20, 40)))) for i in range(20)] + [(90, "Short Item"), (91, None), (92, " "), (0, None)]
    rows, expected = [], set()
    for d in range(120):
        text = " ".join(word() for _ in range(60))
        if d % 2:
            i, t = items[d % 20]
            p = rng.randrange(len(text))
            text = f"{text[:p]} {edit(rng, t, int(0.1 * len(t))).upper()}\n{text[p:]}"
        rows.append((d, text, "clash"))
    rows += [(500, None, ""), (501, "", ""), (502, "a SHORT   item it is", ""), (502, "a SHORT   item it is", ""), (503, "shortitem", ""), (504, "x " * 150_000 + items[3][1], "")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    for d, text, _ in rows:
        norm = decontaminate.normal(text)
        for i, t in items[:20]:
            if len(norm) < 5000 and brute_distance(t, norm) <= decontaminate.budget(t):
                expected.add((d, i))
    expected |= {(502, 90), (504, 3)}
    out = decontaminate.contaminated(docs, bench, block_chars=1500).collect()
    found = {(r.doc_id, r.item_id) for r in out}
    assert found <= expected and len(found) >= 0.95 * len(expected)
    assert sum(r.doc_id == 502 for r in out) == 2
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, *_ in rows} - {d for d, _ in found}
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def recalled(length, share, some_text, letters, n=100):
    """The share of n items of a length that are found in texts that hold them with a share of their characters edited."""
    rng = random.Random(length)
    items, texts = [], []
    for i in range(n):
        items.append((i, some_text(rng, length)))
        passage, around = list(items[-1][1]), some_text(rng, 200)
        for _ in range(int(share * length)):
            p, o = rng.randrange(len(passage)), rng.randrange(3)
            passage[p : p + (o < 2)] = [rng.choice(letters)] if o else []
        texts.append(around[:130] + "".join(passage) + around[130:])
    found = decontaminate.find_all(texts, decontaminate.build(items))
    return sum(any(hit[0] == i for hit in hits) for i, hits in enumerate(found)) / n


@pytest.mark.parametrize("length", [48, 60, 80, 100, 130, 200, 300])
def test_edited_items_are_found(length):
    def words(rng, n):
        return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))[:n].strip().ljust(n, "x")

    for share in (0.1, 0.15, 0.2):
        assert recalled(length, share, words, "etaoinshrdlu ") >= 0.9


@pytest.mark.parametrize("length", [48, 75, 130, 250])
def test_items_in_texts_without_spaces_are_found(length):
    def unspaced(rng, n):
        return "".join(chr(0x4E00 + int(rng.random() ** 2 * 800)) for _ in range(n))

    assert recalled(length, 0, unspaced, "的一是不了") == 1
    assert recalled(length, 0.15, unspaced, "的一是不了") >= 0.9


def test_short_items():
    items = [(1, "what is the capital?"), (2, "forty two"), (3, "首都是哪里呢"), (4, "ab")]
    texts = [
        'He asked: "What is the capital?" twice',
        "what is the captial, then",
        "forty two.",
        "(fourty two)",
        "fortytwo times",
        "问首都是哪裡呢答",
        "abc, cab; ab!",
        "",
        None,
        "what is a dog. the capital",
        "都是哪里呢",
    ]
    found = decontaminate.find_all(texts, decontaminate.build(items))
    assert found == [[(1, 0, 30)], [(1, 2, 19)], [(2, 0, 9)], [(2, 1, 11)], [], [(3, 1, 7)], [(4, 0, 12)], [], [], [], [(3, 1, 5)]]


def test_short_items_against_brute_force():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 6)))) for i in range(25)]
    texts = [" ".join(word() for _ in range(40)) for _ in range(15)]
    found = decontaminate.find_all(texts, decontaminate.build(items))
    for text, hits in zip(texts, found, strict=True):
        words, expected = text.split(), []
        for i, t in items:
            n, near = t.count(" ") + 1, []
            for at in range(len(words) - n + 1):
                passage = " ".join(words[at : at + n])
                near.append((decontaminate.whole_distance(t, passage), len(" ".join(words[: at + n]))))
            if near and min(near)[0] <= decontaminate.budget(t):
                expected.append((i, *min(near)))
        assert hits == expected
