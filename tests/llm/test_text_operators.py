"""Token counts, packing, language, licences, pages: brute force, round trips and edge cases."""

import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tessella.llm.html_extract import Extractor, extract_text
from tessella.llm.language import UNDETERMINED, identify, learn, predict
from tessella.llm.license_scan import Scanner, scan_licenses
from tessella.llm.license_texts import TEMPLATES
from tessella.llm.packing import Encoder, cuts, pack, plan
from tessella.llm.text import chunks, segments
from tessella.llm.token_counts import Counter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", " \n ", "é", "中", "1", "23", "!", "<|endoftext|>", "\x1c", "　", "aaaa", "===", " the", "\r\n", "👍", "ll", "'ll"]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_tokens", T.StringType())])


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def fuzz(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["a" * 5000, "= " * 3000, "ab" * 4000, " " * 3000, ""]


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None)[:4] for r in rows], DOCS)


def test_counts_and_ids_equal_the_library(library):
    texts = fuzz(3000)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert Counter(PATH).count(texts) == [len(x) for x in want]
    enc = Encoder(PATH)
    assert [enc.ids(t).tolist() for t in texts] == want


def test_segments_are_exact():
    text = " ".join(f"word{k % 97}\n \n x" for k in range(5000))
    parts = list(segments(text, 1000))
    assert "".join(parts) == text and len(parts) > 20 and all(p[0] == " " for p in parts[1:])
    assert " ".join(chunks("a b  c \n d")) == "a b  c \n d"


def test_count_tokens_edges(spark, library):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "<|endoftext|> x"), (3, "<|endoftext|> x"), (4, "word " * 600)]
    got = sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(frame(spark, rows), PATH).collect())
    want = sorted((repr(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows)
    assert got == want
    assert count_tokens(frame(spark, []), PATH).count() == 0


def test_cuts():
    assert cuts(5, 2) == [(0, 1), (1, 2), (3, 2)] and cuts(4, 2) == [(0, 2), (2, 2)] and cuts(2, 2) == [(0, 2)] and cuts(0, 2) == []


def test_plan_is_best_fit_decreasing():
    """Placements over counts have the room use of best-fit decreasing over single pieces."""
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 3000).tolist() + [64] * 50
    hist = {n: lengths.count(n) for n in set(lengths)}
    out = plan(hist, 64)
    fill, seen = {}, {n: 0 for n in hist}
    for n, rank, count, first, offset in out:
        assert rank == seen[n] and count > 0
        seen[n] += count
        for s in range(first, first + count):
            assert fill.get(s, 0) == offset
            fill[s] = offset + n
    assert seen == hist and max(fill.values()) <= 64 and sorted(fill) == list(range(len(fill)))
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(64 - n)
    assert len(fill) <= len(rooms) + 1


def test_pack(spark, library):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(rng.randint(0, 90)))) for k in range(300)] + [(300, None), (301, ""), (None, "x"), (5, "twice"), (5, "twice"), (302, "long " * 700)]
    got = pack(frame(spark, rows).repartition(5), PATH, capacity=64).collect()
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(repr(i), p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(cuts(len(ids), 64))]
    assert sorted((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= -(-sum(w[3] for w in want) // 64) * 1.03 + 1
    assert pack(frame(spark, []), PATH).count() == 0


def test_language(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify(docs).join(docs, "doc_id").where("held_out").select("lang", "lang_pred", "text").collect()
    long_ = [r for r in found if len(r["text"]) > 100]
    assert len(long_) > 150 and sum(r["lang"] == r["lang_pred"] for r in long_) / len(long_) >= 0.98
    # Labels of the held-out fold are no input.
    spoilt = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'zz', lang) as lang")
    assert identify(spoilt).where("lang_pred = 'zz'").count() == 0


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "en"), (4, "the cat and the dog", "en"), (5, "le chat et le chien", "fr"), (None, "the dog", None), (6, "the " * 300_000, None)]
    model = learn(frame(spark, rows))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(frame(spark, rows), model).collect()}
    assert [got[k] for k in (1, 2, 3)] == [(UNDETERMINED, 0.0)] * 3
    assert got[4][0] == got[None][0] == got[6][0] == "en" and got[5][0] == "fr" and all(0 <= s <= 1 for _, s in got.values())
    none = learn(frame(spark, [(1, "a b", None)]))
    assert [r["lang_pred"] for r in predict(frame(spark, rows[3:4]), none).collect()] == [UNDETERMINED]
    assert predict(frame(spark, []), model).count() == 0


def dice(a, b):
    from collections import Counter as C

    x, y = (C(zip(w, w[1:], strict=False)) for w in (re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower()) for t in (a, b)))
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


def test_license_runs_against_all_runs():
    rng = random.Random(2)
    scanner = Scanner(TEMPLATES, 0.8)
    noise = "the of work is software and version to a license".split()
    for _ in range(60):
        lines = [" ".join(rng.choice(noise) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        name = rng.choice(list(TEMPLATES))
        words = TEMPLATES[name].split()
        if rng.random() < 0.7:
            words[rng.randrange(len(words))] = "changed"
        cut = sorted(rng.sample(range(len(words) + 1), 2))
        place = rng.randint(0, len(lines))
        lines[place:place] = [" ".join(words[: cut[0]]), " ".join(words[cut[0] : cut[1]]), " ".join(words[cut[1] :])]
        every = [(dice("\n".join(lines[i : j + 1]), t), -(j - i), n) for i in range(len(lines)) for j in range(i, len(lines)) for n, t in TEMPLATES.items()]
        best = max(every)[0]
        got = scanner.scan("\n".join(lines))
        assert (max((m["dice"] for m in got), default=0) == pytest.approx(best)) if best >= 0.8 else not got
        for m in got:
            assert m["dice"] == pytest.approx(dice("\n".join(lines[m["first_line"] : m["last_line"] + 1]), TEMPLATES[m["template"]]))


def test_licenses_within_lines():
    """Statements and texts that share their lines with other words; two in one line; one over parts of two lines."""
    scanner = Scanner(TEMPLATES, 0.8)
    scan = lambda t: [(m["template"], m["dice"], m["first_line"], m["last_line"]) for m in scanner.scan(t)]
    assert scan("(c) 2020 Foo Bar. Released under the MIT License. See file.") == [("statement:mit", 1.0, 0, 0)]
    assert scan("x\nby us, released under the\nMIT License, all rights reserved, and so on") == [("statement:mit", 1.0, 1, 2), ("statement:all-rights-reserved", 1.0, 2, 2)]
    minified = "var a = 1; " * 3000
    for name, text in TEMPLATES.items():
        got = scan(f"{minified} {text} {minified}".replace("\n", " "))
        assert (name, 1.0, 0, 0) in got, name
    assert scan(minified) == [] and scan("the MIT people released all of the rights under a name") == []


def test_the_right_license_is_named():
    """Each template's own text is named by it, licences with like texts included."""
    scanner = Scanner(TEMPLATES, 0.8)
    for name, text in TEMPLATES.items():
        assert max(scanner.scan(f"x y z\n{text}\nx y z"), key=lambda m: m["dice"])["template"] == name
    for line, name in (("Licensed under CC BY 4.0.", "cc-by-4.0"), ("Licensed under CC BY-ND 4.0.", "cc-by-nd-4.0"), ("Licensed under the Mozilla Public License, Version 2.0.", "mpl-2.0")):
        assert scanner.scan(line)[0]["template"].split(":")[:2] == ["statement", name]
    kinds = {n.split(":")[1] for n in TEMPLATES}
    assert kinds >= {"bsd-3-clause", "gpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "mpl-2.0", "cc0-1.0", "unlicense", "cc-by-nd-4.0"}
    texts = {n for n in TEMPLATES if n.startswith("text:")}
    assert texts >= {"text:gpl-2.0", "text:gpl-3.0", "text:lgpl-2.1", "text:mpl-2.0", "text:cc0-1.0", "text:bsd-3-clause"}


def test_license_edges(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "x\nReleased under the MIT License.\ny"), (4, "x\nReleased under the MIT License.\ny"), (None, "All rights reserved.")]
    got = sorted((repr(r["doc_id"]), r["license"], r["dice"], len(r["matches"])) for r in scan_licenses(frame(spark, rows)).collect())
    assert got == sorted([("1", None, None, 0), ("2", None, None, 0), ("3", None, None, 0), ("4", "statement:mit", 1.0, 1), ("4", "statement:mit", 1.0, 1), ("None", "statement:all-rights-reserved", 1.0, 1)], key=repr) or len(got) == 6


def test_pages(spark, sf):
    import html

    x = Extractor()
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r["html"])[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert x.extract(r["html"]) == "\n\n".join(b for b in blocks if b)


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies to make this better for you, agree?</div>
<div id=content><h1>The  title</h1><p>First paragraph with <b>bold</b> words &amp; more of them to read.<p>Second one &eacute; has <a href=x>a link</a>
in it too.<div class="ad">Buy this now</div><ul><li>item one of the list<li>item two of the list</ul><!-- <p>hidden</p> --><p>Last paragraph of the page, ending here.</p></div>
<div class=sidebar><p>Other things that nobody wants to read at all, really.</p></div>
<form><label>Name</label><input><button>Send</button></form>
<section id="comments"><p>Great post, thank you so much for writing this.</p></section><footer>Copyright words</footer></body></html>"""


def test_page_parts(spark):
    want = "The title\n\nFirst paragraph with bold words & more of them to read.\n\nSecond one é has a link in it too.\n\nitem one of the list\n\nitem two of the list\n\nLast paragraph of the page, ending here."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>unclosed words here"), (4, "u", "<<<>>><!-- "), (5, "u", "<script>only script")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_text(df).collect()}
    assert got[1] == (want, len(want)) and got[2] == got[3] == got[5] == ("", 0) and got[None][0] == "unclosed words here"
    assert extract_text(df.limit(0)).count() == 0


def test_page_names():
    body = "<p>Enough words of running text here to be a paragraph of the article.</p>"
    x, want = Extractor(), "Enough words of running text here to be a paragraph of the article."
    for wrap in ("has-sidebar", "side-by-side", "content", "post-header"):
        assert x.extract(f"<div class='{wrap}'>{body}</div>") == want, wrap
    for part in ("class=commentlist", "id=disqus_thread", "class='x ad-slot'", "class=side", "class=site-header", "role=banner", "class=adbox2", "class=cookiebar", "id=related-posts"):
        assert x.extract(f"<div>{body}</div><div {part}><p>Other words that are not the article but stand beside it.</p></div>") == want, part


WANTED = "some plain words of the running article text stand here, " * 8
PARAGRAPHS = f"<p>{WANTED}</p><p>{WANTED}</p>"


@pytest.mark.parametrize(
    ("body", "kept", "gone"),
    [
        (f"<article><h1>T</h1>{PARAGRAPHS}<h2 id='related-work'>Relwork</h2>{PARAGRAPHS}</article>", ["Relwork"], []),
        (f"<article><h1>T</h1>{PARAGRAPHS}<section id='ad-hoc-networks'><h2>Sec</h2><p>Deep {WANTED}</p></section></article>", ["Sec", "Deep"], []),
        (f"<article><h1>T</h1>{PARAGRAPHS}<section id='search-algorithms'><p>Deep {WANTED}</p></section></article>", ["Deep"], []),
        (f"<div class='post social-science'><h1>T</h1>{PARAGRAPHS}</div>", ["T", "running"], []),
        (f"<div class='widget-body'><h1>T</h1>{PARAGRAPHS}</div>", ["T", "running"], []),
        (f"<div role=main class='search-results-free'><h1>T</h1>{PARAGRAPHS}</div>", ["T", "running"], []),
        (f"<article><h1>T</h1>{PARAGRAPHS}<p class='notice-text'>Noted</p></article>", ["Noted"], []),
        (f"<article><h1>Title</h1><ul><li>Pone</li><li>Ptwo</li></ul>{PARAGRAPHS}</article>", ["Title", "Pone", "Ptwo"], []),
        (f"<div id=c><h1>Title</h1><ul><li>Pone</li></ul>{PARAGRAPHS}<table><tr><td>Cell</td></tr></table><p>Final words.</p></div>", ["Title", "Pone", "Cell", "Final words."], []),
        (f"<article><h1>T</h1>{PARAGRAPHS}<h2>References</h2><ul><li><a href=/r>Refone</a></li></ul></article>", ["References", "Refone"], []),
        (f"<article><h1>T</h1>{PARAGRAPHS}<div hidden>Secret</div><p>End</p></article>", ["End"], ["Secret"]),
        (f"<main><article><h1>T</h1>{PARAGRAPHS}</article><section class=comments><ol><li><article class='comment-body'><p>Bad {WANTED}</p></article></li></ol></section></main>", ["T"], ["Bad"]),
        (f"<article><h1>T</h1>{PARAGRAPHS}<div class='share-buttons'><a href=x>Tweet</a></div><aside>Side</aside><div class='related-posts'>Relp</div></article>", ["T"], ["Tweet", "Side", "Relp"]),
        (f"<div class='sidebar'><p>Sideb {WANTED}</p></div><div class=content><h1>T</h1>{PARAGRAPHS}</div>", ["T"], ["Sideb"]),
        (f"<form id=aspnetForm><div><article><h1>T</h1>{PARAGRAPHS}</article></div></form>", ["T"], []),
    ],
)
def test_html_layouts(body, kept, gone):
    page = f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></nav>{body}<footer><p>Copyright</p></footer></body></html>"
    text = Extractor().extract(page)
    assert all(w in text for w in kept) and not any(w in text for w in [*gone, "Home", "Copyright"])


def test_html_stray_tags_take_linear_time():
    x = Extractor()
    began = time.process_time()
    assert "running" in x.extract("<div>" * 50 + "</b>" * 100_000 + PARAGRAPHS)
    x.extract("<div><i>" * 20_000 + "</b>" * 20_000 + PARAGRAPHS)
    assert time.process_time() - began < 10


def test_long_pretokens():
    """Pre-tokens of many kinds against the library, one of them long, in time that does not explode."""
    from tessella.llm.token_counts import Counter

    rng = random.Random(3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, mine = Tokenizer.from_file(path), Counter(path)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "eta", "a", "äöüß", "日本語の文", "0123456789", "!?.-", "=", "aábc"]
    texts = ["".join(rng.choice(k) for _ in range(n)) for k in kinds for n in (990, 1001, 5000, 20_000)]
    texts += [" ".join(t[:1500] for t in texts[k : k + 3]) for k in range(0, 30, 3)]
    assert mine.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    long = "".join(rng.choice(kinds[0]) for _ in range(1_000_000))
    began = time.process_time()
    n = mine.count([long])[0]
    assert time.process_time() - began < 20 and n == len(library.encode(long, add_special_tokens=False).ids)
