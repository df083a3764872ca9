"""Operators against brute force, round trips and held-out labels."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keystrata.llm import common, decontam, html_extract, lengths, neardup, packing, pii, quality, registry, substring, token_codes, tokens, toxicity, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", "<|startoftext|>a <|endoftext|", "a\nB c.\nD", "a\n\nb", "\u0130\u0130", "x,.!? y\n z", "a\x0bb\nc", "a  b", "x   y ", "\n a b\n\n c", " lead", "tab\tx y", "é ́x", "<|endoftext|> q a<|endoftext|>", "ΑΣ Σ", "1234 a1b", "don't we'll ' s", "İstanbul ŒUVRE", "a. b", "漢字 🙂 x", "w" * 300 + " v"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))
    out = [prose(rng.choice([3, 12, 40, 120])) for _ in range(60)]
    passage = prose(25)
    for k in range(5, 60, 5):
        out[k] += " " + passage + " " + prose(5)
    for k in range(7, 60, 9):
        other = out[k - 1].split(" ")
        other[len(other) // 2] = "changed"
        out[k] = " ".join(other)
    out[20], out[21] = out[3], " ".join(["of"] * 40)
    out[22] = "x " + " ".join(["of"] * 25)
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s") for k, t in texts.items()], "doc_id long, text string, lang string, source string").repartition(4)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name, texts):
    path = tokens.default_path(name)
    plain = Tokenizer.from_file(path)
    rng = random.Random(3)
    signs = ["a", "B", "é", "\n", " ", "\t", ".", ",", "'s", "1", "漢", "<|endoftext|>", "\u0301", "ß", "\u00a0", "\u1e9e", "ll", "\x1f"]
    all_ = [*ODD, *texts.values(), *("".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(3000))]
    own = tokens.PieceEncoder(path, most=50)  # also with a cache that keeps overflowing
    for text, ids in zip(all_, own.encode(all_), strict=True):
        assert ids == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_pieces_cover_each_id_once(docs, texts):
    for n in (1, 2, 2047, 2048, 2049, 5000):
        found = packing.pieces(n)
        assert [a for a, _ in found] == [0, *itertools.accumulate(s for _, s in found)][:-1] and sum(s for _, s in found) == n
        assert all(s & (s - 1) == 0 for _, s in found)
    plain = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    got = defaultdict(dict)
    for r in packing.pack(docs).collect():
        got[r.doc_id][r.start] = r.ids
    for k, t in texts.items():
        assert b"".join(got[k][s] for s in sorted(got[k])) == np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (513, 300), (5000, 49_000), (700, 2**32)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        code = token_codes.Code(token_codes.encode(ids))
        assert len(code) == n and (code.decode() == ids).all()
        assert n == 0 or token_codes.encode_many([ids, ids[:1], ids[: n // 2 + 1]]) == [token_codes.encode(x) for x in (ids, ids[:1], ids[: n // 2 + 1])]
        assert all(code[int(i)] == ids[i] for i in rng.integers(0, n, 50 if n else 0))
    with pytest.raises(IndexError):
        code[n]


def test_code_files(spark, docs, texts, tmp_path):
    path = f"file://{tmp_path}/codes"
    token_codes.write(docs, path, shards=4)
    plain = Tokenizer.from_file(tokens.default_path("word_bpe_49k.json"))
    at = 0
    rows = {r.doc_id: r for r in token_codes.digests(token_codes.read(spark, path)).collect()}
    for k, t in sorted(texts.items()):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    ask = spark.createDataFrame([(3, 0), (3, 10**6), (5, 4)], "doc_id long, position long")
    got = {(r.doc_id, r.position): r.token for r in token_codes.token_at(spark, path, ask).collect()}
    assert got[3, 10**6] is None and got[5, 4] == plain.encode(texts[5], add_special_tokens=False).ids[4]


def test_length_sums(docs, texts):
    plain = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    all_ = [len(plain.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values()]
    hist = lengths.histogram(docs)
    for r in lengths.suffix_sums(hist).collect():
        limit = r.limit_tokens
        assert (r.n_docs, r.docs_longer, r.tokens_total, r.docs_total) == (all_.count(limit), sum(x > limit for x in all_), sum(all_), len(all_))
        assert r.tokens_truncated == sum(min(x, limit) for x in all_) and r.tokens_lost == sum(all_) - r.tokens_truncated and r.tokens_up_to == sum(x for x in all_ if x <= limit)
    ordered = sorted(all_)
    for r in lengths.quantiles(hist, [0.5, 0.9]).collect():
        assert r.n_tokens == min(x for x in ordered if sum(y <= x for y in ordered) >= r.share * len(ordered))


def test_window_symbols_depend_on_the_window_alone():
    rng = random.Random(2)
    for size in (1, 2, 3, 6, 60):
        vocabulary = [b"w%d" % i for i in range(size)]
        docs = [b" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 70))) for _ in range(8)]
        docs[5] += b" " + b" ".join(docs[0].split()[3:40])
        w = words.split_words(docs)
        flat = [x for d in docs for x in d.split()]
        seen = {}
        for at, symbol in zip(*substring.window_symbols(w), strict=True):
            assert seen.setdefault(tuple(flat[at : at + 13]), symbol) == symbol


def test_repeats(docs, texts):
    split = {k: WORD.findall(t) for k, t in texts.items()}
    first = {}
    for k in sorted(split, reverse=True):
        for i in range(len(split[k]) - 12):
            first[tuple(split[k][i : i + 13])] = k
    for r in substring.remove_repeats(docs, digest=True).collect():
        own = split[r.doc_id]
        gone = {j for i in range(len(own) - 12) if first[tuple(own[i : i + 13])] < r.doc_id for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(own) if j not in gone)
        assert (r.n_words, r.n_removed, r.kept) == (len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def _components(sets):
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and root(a) != root(b):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: root(k) for k in sets}


def test_near_duplicates(docs, texts):
    split = {k: WORD.findall(t.lower()) for k, t in texts.items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in split.items()}
    want = _components(sets)
    assert any(k != v for k, v in want.items())
    for r in neardup.near_duplicates(docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_forest_in_blocks(spark, docs, texts, monkeypatch):
    want = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    monkeypatch.setattr(neardup, "BLOCK", 1)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == want


def test_forest():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.choice(2**40, rng.integers(1, 60), replace=False).astype(np.uint64)
        sets = [np.unique(np.concatenate((base[rng.random(len(base)) > rng.choice([0, 0.05, 0.1, 0.2])], rng.choice(2**40, rng.integers(1, 6)).astype(np.uint64)))) for _ in range(rng.integers(1, 30))]
        ids = rng.permutation(1000)[: len(sets)]
        want = _components({int(i): set(s.tolist()) for i, s in zip(ids, sets, strict=True)})
        assert set(neardup.forest(ids.astype(np.int64), sets)) == {(c, k) for k, c in want.items() if c != k}


def test_overlaps_with_substitutions(spark):
    rng = random.Random(1)
    item = [f"q{rng.randint(0, 10**6)}" for _ in range(16)]
    rows, want = [], {}
    for k, gone in enumerate([(), (0,), (3, 9), (15, 0), (1, 2, 3)]):
        text = [("X" + w if j in gone else w).upper() for j, w in enumerate(item)]
        rows.append((k, " ".join(["pre", *text, "post"])))
        want[k] = len(gone) <= 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontam.decontaminate(docs, bench).collect()} == want
    for errors in itertools.combinations(range(16), 2):
        assert any(not set(errors) & set(mask) for mask in decontam.MASKS)


def test_short_items_with_substitutions(spark):
    """Items of 8 to 15 words are found whole with any one word substituted; pieces of 8 words still are, two substitutions aren't."""
    rng = random.Random(2)
    items = {n: [f"q{rng.randint(0, 10**6)}" for _ in range(n)] for n in range(8, 16)}
    rows, want = [], {}
    for n, item in items.items():
        for gone in [(), *((j,) for j in range(n)), (n // 4, n // 2)]:
            want[len(rows)] = len(gone) < 2
            rows.append((len(rows), " ".join(["pre", *("X" if j in gone else w for j, w in enumerate(item)), "post"])))
        want[len(rows)] = True
        rows.append((len(rows), " ".join(["pre", *item[n - 8 :], "post"])))
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()} == want


def test_items_of_a_few_words(spark):
    """Items of 5 to 7 words are found whole and unchanged; shorter ones aren't looked for."""
    items = {n: [f"q{n}x{k}" for k in range(n)] for n in (3, 4, 5, 6, 7)}
    rows = [(n, " ".join(["pre", *item, "post"])) for n, item in items.items()] + [(10 + n, " ".join(["pre", *item[:-1], "post"])) for n, item in items.items()]
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {k: str(k) if 5 <= k <= 7 else "" for k, _ in rows}


def test_base_statistics(texts):
    odd = [*texts.values(), "a a a a a a\n\na a a a a a\n b\nb\n b", "#x | <y>\n#x | <y>", "é漢 ü"]
    counts = quality.count_texts([t.encode() for t in odd])
    for k, t in enumerate(odd):
        w = WORD.findall(t)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(int(counts[c][k]) for c in quality.COUNTS[:5]) == want


def test_outliers_are_rejected(spark):
    rng = random.Random(6)
    good = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(15, 200))), "en", "s") for k in range(300)]
    bad = [(1000 + k, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + "%%#" for _ in range(80)), "en", "s") for k in range(40)]
    rows = quality.score(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in rows)


def _luhn(d):
    return sum((2 * int(c) - 9 if 2 * int(c) > 9 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def test_base_spans(spark):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(9)
    parts = ["a.b@c.de", "x@y", "a@b.c_d@e.f", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "000255.1.1.1", "4539 1488 0343 6467", "4539148803436467", "1234567812345678", "+1 (203) 555-8282", "+49 30 1234567 ", "+1", "12-34", "é🙂", "word", "\n", ".", "-", " ", " ", "7"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for k in range(400)] + [(1000, "1.1.1.1 " * 300)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), model={}).collect()}

    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and _luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    for k, t in rows:
        want = [f"{kind}:{m.start()}:{m.end()}" for kind, p in patterns.items() for m in re.finditer(p, t) if valid(kind, m[0])]
        assert found[k].base == want == found[k].spans, t


def test_added_spans(spark):
    """A phone number and a card number side by side spoil each other's base match; the trees bring both back."""
    rng = random.Random(3)
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"

    def card():
        head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(head + c for c in "0123456789" if _luhn(head + c))

    rows = [(k, f"some words {phone()} here {card()} and a{rng.randint(10**9, 10**11)}z there") for k in range(300)]
    rows.append((1000, f"call {phone()} {card()} now"))
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] == ["card:23:39", "phone:5:22"] and all(len(v) == 2 for k, v in got.items() if k < 1000)


def test_loose_spans_when_frequent(spark):
    """Forms that no base span has are added where they are more frequent than base spans; what only looks like them isn't."""
    rng = random.Random(12)

    def card(n):
        head = "37" + "".join(rng.choice("0123456789") for _ in range(n - 3))
        return next(head + c for c in "0123456789" if _luhn(head + c))

    make = {
        "email": lambda: f"user{rng.randint(0, 99)} (at) host{rng.randint(0, 99)} (dot) com",
        "ip": lambda: "[.]".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": lambda: card(15),
        "phone": lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
        "": lambda: rng.choice([f"x{rng.randint(10**9, 10**10 - 1)}z", "999[.]1[.]1[.]1", f"id {rng.randint(10**9, 10**10 - 1)}", "come @ noon. Then"]),
    }
    base = ["a.b@c.de", "1.2.3.4", "4539148803436467", "+1 (203) 555-8282"]
    rows, want = [], {}
    for k in range(400):
        kind = [*make][k % 5]
        m = make[kind]()
        rows.append((k, f"some words {m} there"))
        want[k] = [f"{kind}:11:{11 + len(m)}"] if kind else []
    rows += [(1000 + k, f"some words {b} there") for k, b in enumerate(base)]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v for k, v in got.items() if k < 1000} == want


def test_rare_kinds_in_large_tables(spark):
    """A kind that one document in thousands holds has a model, whatever the number of rows."""
    rows = spark.range(40_000).selectExpr("id as doc_id", "if(id = 77, 'mail me (at) host (dot) org or a@b.org', concat('plain text of row ', id)) as text").repartition(4)
    assert [r.spans for r in pii.find(rows).where("doc_id = 77").collect()] == [["email:5:27", "email:31:38"]]
    assert pii.train(rows).keys() == {"email"}


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 6 == 0
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(2, 6) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["zorq", "vlim"]) + rng.choice(["a", "en", "ish", "ul"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.97


def test_wrapper_and_text():
    page = "<html><body><header><h2>Site</h2></header><nav><ul><li><a href=x>A</a><li><a>B</a></ul></nav><div id='content'><div class='sidebar'><p>side</div><h1>Big &amp; news</h1><p>One <b>two<br>three<p>Four &nbsp; five{}<div class=comments><p>hi</div></div><form>f</form><footer>c</footer><script>if(a<b)'</p>'</script>"
    whole = html_extract.merge(html_extract.wrapper_of(page.format("")), html_extract.wrapper_of(page.format("<ul><li>x<li>y</ul>")))
    assert "(<li>#text</>)+" in html_extract.regular_expression(whole) and ")?" in html_extract.regular_expression(whole)
    plan = html_extract.choose(whole)
    assert html_extract.extract(page.format(""), plan) == "Big & news\nOne two three\nFour five"
    assert html_extract.extract(page.format("<ul><li>x<li>y</ul>"), plan).endswith("five\nx\ny")
    groups = html_extract.wrapper_of("<dl>" + "<dt>a<dd>b" * 3 + "</dl>")
    assert html_extract.regular_expression(groups) == "<dl>((<dt>#text</><dd>#text</>))+</>"


def test_templates_of_one_host(spark):
    """Pages of each template keep their article, whatever the others have; pages without a host don't share a plan."""
    words_ = " ".join(f"w{k}" for k in range(40))
    make = {
        "article": "<body><nav><a>n</a></nav><article><p>{0}</p></article><div class=promo>x</div></body>",
        "post": "<body><nav><a>n</a></nav><div class=post><p>{0}</p></div></body>",
        "story": "<body><div class=story><h1>t</h1><p>{0}</p></div></body>",
        "mixed": "<body><article><p><a>teaser</a></article><div class=post><p>{0}</p></div></body>",
    }
    rows, want = [], {}
    for url, kinds in (("http://a.org/", ["article"] * 6 + ["post"]), ("http://b.org/", ["post"] * 9 + ["story"]), ("http://c.org/", ["article"] * 3 + ["mixed"]), (None, ["article", "article", "post", "story"])):
        for kind in kinds:
            k = len(rows)
            rows.append((k, url and f"{url}{k}", make[kind].format(f"{words_} {k}")))
            want[k] = ("t\n" if kind == "story" else "") + f"{words_} {k}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.main_text(pages).collect()} == want


def test_limits_between_lengths(spark):
    lengths_ = [3] * 4 + [7] + [1500] * 2 + [5000]
    hist = spark.createDataFrame(list(Counter(lengths_).items()), "n_tokens long, n_docs long")
    limits = [1, 3, 5, 1024, 1500, 4096, 5000, 10_000, 1024]
    got = {r.limit_tokens: (r.docs_longer, r.tokens_up_to, r.tokens_truncated, r.tokens_lost) for r in lengths.at_limits(hist, limits).collect()}
    cut = {x: sum(min(n, x) for n in lengths_) for x in limits}
    assert got == {x: (sum(n > x for n in lengths_), sum(n for n in lengths_ if n <= x), cut[x], sum(lengths_) - cut[x]) for x in limits}
    assert lengths.at_limits(hist.limit(0), limits).count() == 0


def test_constant_text_is_left_out(spark):
    """A host's fixed lines inside the article aren't article text; copies of one page keep theirs."""
    page = "<body><article><p>{0} story</p><p>more of {0} here</p><div class=about><p>About this site</p></div><p>All rights are ours.</p></article></body>"
    rows = [(k, f"http://a.org/{k}", page.format(f"own text {k}")) for k in range(8)] + [(100 + k, f"http://b.org/?ref={k}", page.format("same")) for k in range(8)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[k] == f"own text {k} story\nmore of own text {k} here" for k in range(8))
    assert all(got[100 + k] == "same story\nmore of same here\nAbout this site\nAll rights are ours." for k in range(8))


def test_names_after_long_class_lists():
    utility = " ".join(f"md:flex-{c}-long" for c in "abcdef")
    page = f"<body><div class='{utility} main'><p>one</p><div class='{utility} sidebar'>side</div><div class='{utility} comments'><p>hi</p></div><div class='{utility} intro'>two</div></div><div class='{utility} x'><p>{'outside ' * 20}</p></div>"
    assert html_extract.extract(page, html_extract.choose(html_extract.wrapper_of(page))) == "one\ntwo"


def test_registered():
    names = [n for n in registry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))


def test_windows_that_agree_in_64_bits_only():
    """Of pairs with one 64-bit fingerprint only those that agree in the further bits count as repeats."""
    keys, docs, more = (np.array(x, t) for x, t in (([1, 1, 1, 2], np.uint64), ([1, 2, 3, 3], np.int64), ([5, 6, 5, 5], np.uint16)))
    assert [x.tolist() for x in substring._later(keys, docs, more)] == [[1], [3], [5]]
    w = words.split_words([b" ".join(b"w%d" % k for k in range(20))], second=True)
    at, h = w.windows(13)
    further = substring.further_bits(w, at, 13)
    own, gone = h[2:3].tobytes(), lambda sets, more: substring._covered(w, [sets], [more], 13).sum()
    assert gone(own, further[2:3].tobytes()) == 13 and gone(own, (further[2:3] ^ np.uint16(1)).tobytes()) == 0
    assert gone(np.repeat(h[2:3], 2).tobytes(), np.array([0, further[2]], np.uint16).tobytes()) == 13


def test_small_groups_lean_on_their_language(spark):
    """A source with a handful of texts is judged by its language: its own odd ones don't make the rule."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    rows = [(k, " ".join(word() for _ in range(rng.randint(15, 200))), "en", f"s{k % 3}") for k in range(300)]
    rows += [(1000 + k, " ".join(word() + "%%#" for _ in range(80)), "en", "rare") for k in range(5)]
    rows += [(2000 + k, " ".join(word() for _ in range(80)), "en", "rare") for k in range(2)]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept == (not 1000 <= r.doc_id < 2000) for r in got)


def test_pages_of_odd_markup():
    one = lambda page: html_extract.extract(page, html_extract.choose(html_extract.wrapper_of(page)))
    assert one("<body class='single has-sidebar'><p>main text here</p></body>") == "main text here"
    assert one("<body><article class='post no-comments'><p>main text here</p></article></body>") == "main text here"
    assert one("<body><form id=f action=x><nav>n</nav><div><p>main text here and more of it</p></div></form></body>") == "main text here and more of it"
    assert one("<body><div><p>One article text here</p><form><p>sub</p><input></form></div></body>") == "One article text here"
    assert one("<body><p class=\"a>One</p><p id=\"x\">Two</p></body>") == "One\nTwo"
    assert one("<body><p title='a > b'>One</p><p data-x='<b>q</b>' id=x>Two</p></body>") == "One\nTwo"
    deep = "<div>" * 1000 + "<p>in deep</p><div class=comments><p>hi</p></div>" + "</div>" * 500 + "<p>half way</p>" + "</div>" * 500
    assert one(f"<body>{deep}</body>") == "in deep\nhalf way"


def test_align_long_sequences():
    """Beyond the exact table: pairs are in order, equal, and nearly as many as the longest common subsequence has."""
    rng = random.Random(1)
    a = [f"x{k}" for k in range(4000)]
    b = [x for x in a if rng.random() > 0.2]
    for k in range(0, len(b), 7):
        b.insert(k, f"y{k}")
    for x, y, least in ((a, b, 0.99 * sum(z in set(a) for z in b)), ([rng.choice("abcd") for _ in range(900)], [rng.choice("abcd") for _ in range(900)], 200)):
        pairs = html_extract.align(x, y)
        assert all(x[i] == y[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs)) and len(pairs) >= least


def test_main_text_of_generated_sites(spark):
    """Against the blocks that each page was made from: menus, notices, asides, comments and a host's fixed lines go, the article stays whole."""
    rng = random.Random(11)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(8, 30)))
    rows, want = [], {}
    for site in range(5):
        fixed, shape = line(), site % 3
        for k in range(8):
            blocks = [line() for _ in range(rng.randint(2, 6))]
            body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" if i % 2 else f"<ul><li>{b}</li></ul>" for i, b in enumerate(blocks[1:]))
            body = (f"<article>{body}<p>{fixed}</p></article>", f"<main class='has-sidebar'>{body}</main><aside>{line()}</aside>", f"<div id=wrap><div class=post>{body}</div><div class='ad box'>{line()}</div></div>")[shape]
            page = f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>home</a></li></ul></nav><header>{fixed}</header>{body}<section class=comments><p>{line()}</p></section><footer>{fixed}</footer><script>var a = '<p>x</p>'</script></body></html>"
            rows.append((len(rows), f"http://s{site}.org/{k}", page))
            want[len(rows) - 1] = "\n".join(blocks)
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want


def test_estimate_against_brute_force(spark):
    """The centre and the rejected rows are those of an exhaustive search: exact concentration steps from many random starts."""
    rng = np.random.default_rng(5)
    d = len(quality.FLOORS)
    mix = np.eye(d) + 0.4 * rng.normal(size=(d, d))
    good = rng.normal(size=(600, d)) @ mix + 3
    bad = 9 + 0.3 * rng.normal(size=(120, d))
    x = np.concatenate((good, bad))
    h, best = int(np.ceil(quality.SUPPORT * len(x))), (np.inf, None)
    for _ in range(60):
        take = rng.choice(len(x), d + 1, replace=False)
        for _ in range(30):
            center, scatter = x[take].mean(axis=0), np.cov(x[take].T, bias=True) + 1e-6 * np.eye(d)
            off = x - center
            take = np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(scatter), off), kind="stable")[:h]
        det = np.linalg.slogdet(np.cov(x[take].T, bias=True))[1]
        if det < best[0]:
            best = det, x[take].mean(axis=0)
    rows = spark.createDataFrame([("en", "s", *map(float, r)) for r in x], "g_lang string, g_source string, " + ", ".join(f"x{i} double" for i in range(d)))
    params, groups = quality.estimate(rows, steps=8)
    (got,) = params.collect()
    assert groups == 3 and np.abs(np.array(got.center) - best[1]).max() < 0.15
    off = x - np.array(got.center)
    far = np.einsum("ij,jk,ik->i", off, np.array(got.precision).reshape(d, d), off) > quality.CUTOFF
    assert far[600:].all() and far[:600].mean() < 0.02


def test_toxicity_against_plain_python(spark):
    """The lexicon is the one that loops over the labelled texts give, and a score is the classifier's on plain counts."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = {}, {}
    for k in range(400):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        labels[k] = int(k % 5 == 0)
        for _ in range(rng.randint(1, 4) if labels[k] else 0):
            w[rng.randrange(len(w))] = rng.choice(["zorqa", "zorqen", "Vlimish,"])
        rows[k] = " ".join(w)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    truth = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    lexicon, classifier = toxicity.train(docs, truth)
    own = [k for k in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    counts = {y: Counter() for y in (0, 1)}
    for k in own:
        counts[labels[k]].update({u for t in rows[k].split() if (w := toxicity.clean(t)).isalpha() for u in toxicity.units_of(w)})
    n = [sum(labels[k] == y for k in own) for y in (0, 1)]
    ratio = {u: (c + 0.1) / (n[1] + 1) / ((counts[0][u] + 0.5) / (n[0] + 1)) for u, c in counts[1].items() if c >= max(3, n[1] // 250)}
    want = {u: toxicity.KINDS.index(u[0]) * 3 + sum(r < t for t in toxicity.TIERS) for u, r in ratio.items() if r >= toxicity.LEAST_RATIO}
    assert lexicon == want and any(u.startswith("4zorq") for u in want)
    plain = {}
    for k, t in rows.items():
        hits = Counter(lexicon[u] for x in t.split() for u in toxicity.units_of(toxicity.clean(x)) if u in lexicon)
        words_ = t.split()
        rest = [len(words_), sum(x.isupper() for x in words_), t.count("!"), sum(c in "#*$%&|" for c in t), sum(a == b for a, b in itertools.pairwise(words_))]
        plain[k] = float(classifier(toxicity.features(np.array([[hits[g] for g in range(toxicity.GROUPS)] + rest])))[0])
    got = {r.doc_id: r.score for r in toxicity.score(docs, truth).collect()}
    assert all(abs(got[k] - plain[k]) < 1e-9 for k in rows)


def test_pipeline_against_plain_stages(spark, tmp_path):
    """What is left, and how it is packed, from a table whose every row has a known fate."""
    import corpus_pipeline

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = {k: prose(rng.randint(40, 160)) for k in range(120)}
    item = prose(30)
    near = texts[3].split(" ")
    near[len(near) // 2] = "other"
    gone = {200: texts[3], 201: " ".join(near) + " end", 202: f"{prose(20)} {item} {prose(20)}", 203: None, 204: "", 205: "too short", 206: " ".join(["again and again it says so"] * 20), 207: " ".join(word() + "%%#" for _ in range(80))}
    secret = {300: (f"{prose(30)} mail a.b@c.de {prose(30)}", "a.b@c.de", "[EMAIL]"), 301: (f"{prose(30)} at 10.1.2.3 {prose(30)}", "10.1.2.3", "[IP]")}
    rows = [(k, t, "en", f"s{k % 2}") for k, t in (*texts.items(), *gone.items(), *((k, t) for k, (t, _, _) in secret.items()))]
    rows.append((None, prose(50), None, None))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/t/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/t/benchmark.parquet")
    got = defaultdict(dict)
    for r in corpus_pipeline.run(spark, f"{tmp_path}/t").collect():
        got[r.doc_id][r.start] = r.ids
    plain = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    want = {**texts, **{k: t.replace(a, b) for k, (t, a, b) in secret.items()}, None: rows[-1][1]}
    assert got.keys() == want.keys()
    for k, t in want.items():
        assert b"".join(got[k][s] for s in sorted(got[k])) == np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes(), k


def _shuffles(spark, at_most):
    """Shuffles whose files are kept, after some time to become no more than so many."""
    count = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    until = time.monotonic() + 3
    while count() > at_most and time.monotonic() < until:
        time.sleep(0.1)
    return count()


def test_forget_lets_go_of_the_newest_step(spark):
    common.forget(spark)
    before = _shuffles(spark, 0)
    for _ in range(3):
        table = common.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "newest")
        common.forget(spark)
        assert _shuffles(spark, before) <= before
        assert table.count() == 7
        common.drop(table)


def test_substring_holds_one_exchange_at_a_time(spark, monkeypatch):
    """Pairs meet when the shuffles before are gone, and windows don't meet in the step that shuffles texts."""
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(300)]
    rows = []
    for k in range(40):
        own = [f"w{rng.randint(0, 10**9)}" for _ in range(30)]
        at = rng.randint(0, 260)
        rows.append((k, " ".join(own[:15] + passage[at : at + 40] + own[15:])))
    docs = spark.createDataFrame(rows, "doc long, text string")
    common.forget(spark)
    before, held, plans, write = _shuffles(spark, 0), [], [], common.materialize

    def step(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        if "FlatMapGroups" in plans[-1]:
            held.append(_shuffles(spark, before))
        return write(df, name)

    monkeypatch.setattr(common, "materialize", step)
    found = substring.repeated_windows(docs).collect()
    assert held and max(held) <= before
    assert any("Join" in p for p in plans) and not any("Join" in p and "FlatMapGroups" in p for p in plans)
    # All windows of 13 words that start in a smaller document, one row a document.
    first, want = {}, {}
    for k, text in rows:
        own = text.split()
        want[k] = len({w for i in range(len(own) - 12) if first.setdefault(w := tuple(own[i : i + 13]), k) < k})
    assert len({r.doc for r in found}) == len(found)
    assert {r.doc: len(r["keys"]) // 8 for r in found} == {k: n for k, n in want.items() if n} and all(len(r.more) * 4 == len(r["keys"]) for r in found)
