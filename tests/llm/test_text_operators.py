"""HTML extraction, BPE, secrets and token counts against plain versions."""

import hashlib
import json
import math
import random
import re

import public_tokenizers as P
import pytest
import tiktoken

from tideline.llm import bpe, html, secrets
from tideline.llm.token_counts import TrieCounter, token_counts, zipf_scores


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.ranks_of(f.read())


# -- byte-level BPE ----------------------------------------------------------------------------------------------------
PIECES = ["a", "b", "the", " ", "  ", "\n", "'s", "'", "é", "ß", "中", "12", "3", "!", "...", "\x1c", "\u00a0", "A", "ing", "😀", "\u0301", "ll", "'ll"]


@pytest.mark.parametrize(("leaf", "window"), [(1, 1), (3, 1), (7, 2), (64, 2)])
def test_tree_encoding_equals_the_library(ranks, leaf, window):
    codec, rnd = bpe.Codec(ranks, P.PATTERN, leaf, window), random.Random(leaf)
    for _ in range(400):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 60)))
        ids = codec.encode(text)
        assert ids == codec.core.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, "abcde" * 6_000, " " * 30_000, "中文" * 9_000, "!" * 30_000, "the cat " * 5_000])
def test_long_runs(ranks, text):
    codec = bpe.Codec(ranks, P.PATTERN)
    assert codec.encode(text) == codec.core.encode_ordinary(text)


def test_every_token_is_what_its_bytes_merge_to(ranks):
    """What the pairwise proof of a join rests on: merging a token's own bytes by rank gives the token."""
    rnd = random.Random(1)
    for token in rnd.sample(sorted(ranks), 3000):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best = min(((ranks.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1)))
            if best[0] is math.inf or best[0] == math.inf:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert parts == [token]


def test_bpe_over_a_table(spark, corpus, clashing):
    core = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    import numpy as np

    encoded = bpe.bpe_encode(clashing)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoded.collect()), key=str)
    want = []
    for i, t, *_ in corpus:
        ids = core.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert sorted(r.text for r in bpe.bpe_decode(encoded).collect()) == sorted((t or "") for _, t, *_ in corpus)


# -- token counts ------------------------------------------------------------------------------------------------------
def best_split(scores, token):
    n = len(token)
    best = [(0.0, 0)] + [(-math.inf, 0)] * n
    for end in range(1, n + 1):
        for start in range(end):
            if (s := scores.get(token[start:end])) is not None:
                best[end] = max(best[end], (round(best[start][0] + s, 9), best[start][1] - 1))
    return -best[n][1]


def test_shared_prefixes_are_computed_once(ranks):
    scores, rnd = zipf_scores(ranks), random.Random(3)
    counter = TrieCounter(scores)
    tokens = ["".join(rnd.choice("abcdeé nst") for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    for t in tokens:
        assert counter[t] == best_split(scores, t.encode())
    assert counter.computed == len({t.encode()[:k] for t in tokens for k in range(1, len(t.encode()) + 1)})


def test_counts_do_not_depend_on_the_memory_bound(ranks):
    scores = zipf_scores(ranks)
    small, large = TrieCounter(scores, most=20), TrieCounter(scores)
    for t in ["hello", "help", " hello", "world", "wörld"] * 3:
        assert small[t] == large[t]


def test_long_pre_tokens_stay_out_of_the_trie(ranks):
    import tracemalloc

    scores, rnd = zipf_scores(ranks), random.Random(8)
    counter, short = TrieCounter(scores), TrieCounter(scores, long=0)
    for _ in range(200):
        t = "".join(rnd.choice("abcdeé nst中") for _ in range(rnd.randint(1, 300)))
        assert short[t] == counter[t] == short.pass_through(t.encode())
    assert short.computed == 0
    tracemalloc.start()
    assert counter["ab" * 1_000_000] > 0
    assert tracemalloc.get_traced_memory()[1] < 30e6  # the trie of 2 MB would take 600 MB
    tracemalloc.stop()


def test_token_counts_over_a_table(spark, corpus, clashing, ranks):
    import regex

    scores, split, known = zipf_scores(ranks), regex.compile(P.PATTERN), {}
    want = []
    for i, t, *_ in corpus:
        if t and len(t) > 5000 and " " not in t:
            continue  # quadratic in the plain version
        found = split.findall(t or "")
        for x in set(found) - set(known):
            known[x] = best_split(scores, x.encode())
        want.append((i, len(found), sum(known[x] for x in found)))
    got = [tuple(r) for r in token_counts(clashing).collect()]
    assert not set(want) - set(got)
    assert len(got) == len(corpus)


# -- secrets -----------------------------------------------------------------------------------------------------------
KINDS = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def plain_base(text):
    out = [(m.start(), m.end(), k) for k, (p, ok) in KINDS.items() for m in p.finditer(text) if ok(m)]
    return sorted(out, key=lambda s: (s[0], list(KINDS).index(s[2])))


def test_base_spans_equal_plain_scans():
    rnd = random.Random(2)
    parts = ["token", "Secret", "apikey", "API_KEY", "passwd", "password", "=", ":", " ", '"', "'", "abc", "abcdef", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "deadbeef", "é", "😀", "secretoken", "\n", "-", "ſecret", "toKen"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert [s for s in secrets.find_secrets(text) if s[2] in KINDS] == plain_base(text), text


def test_checksums_decide():
    body = "A" * 30
    good = "ghp_" + body + secrets.crc_base62(body.encode()).decode()
    assert secrets.find_secrets(f"é {good}.") == [(2, 42, "crc_token")]
    assert secrets.find_secrets(good[:-1] + ("0" if good[-1] != "0" else "1")) == []
    import base64

    b64 = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    assert [s[2] for s in secrets.find_secrets(f"{b64({'alg': 'HS256', 'typ': 'JWT'})}.{b64({'a': 1})}.c2ln")] == ["jwt"]
    assert secrets.find_secrets("eyJabc.def.ghi") == []
    key = base64.b64encode(b"\x30\x81\xc8" + b"x" * 200).decode()
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{key}\n-----END RSA PRIVATE KEY-----"
    assert secrets.find_secrets("a " + pem) == [(2, 2 + len(pem), "pem_key")]


def test_embedded_checksums_of_keys():
    def base58(raw):
        n, out = int.from_bytes(raw, "big"), ""
        while n:
            n, r = divmod(n, 58)
            out = chr(secrets.BASE58[r]) + out
        return out

    payload = bytes.fromhex("0488ade4") + bytes(range(74))
    key = base58(payload + hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4])
    assert secrets.find_secrets(f"key {key} ") == [(4, 4 + len(key), "xprv")]
    assert secrets.find_secrets(key[:50] + ("a" if key[50] != "a" else "b") + key[51:]) == []
    data = [i % 32 for i in range(52)]
    rest = secrets.bech32_rest(b"AGE-SECRET-KEY-", [*data, *[0] * 6]) ^ 1
    age = "AGE-SECRET-KEY-1" + "".join(chr(secrets.BECH32[v]) for v in [*data, *(rest >> 5 * (5 - i) & 31 for i in range(6))])
    assert secrets.find_secrets("é" + age) == [(1, 1 + len(age), "age_key")]
    assert secrets.find_secrets(age[:-1] + ("Q" if age[-1] != "Q" else "P")) == []
    import base64

    short = base64.b64encode(b"\x30\x81\xc8" + b"x" * 199).decode()
    assert secrets.find_secrets(f"-----BEGIN PRIVATE KEY-----{short}-----END PRIVATE KEY-----") == []


@pytest.mark.parametrize("piece", ["eyJ", "eyJa.", "token ", "token=", "AKIA", "ghp_", "-----BEGIN ", "-----BEGIN A", "xprv", "age-secret-key-1", "secret:'", "a1"])
def test_hostile_texts_take_linear_time(piece):
    import time

    start = time.process_time()
    secrets.find_secrets(piece * (500_000 // len(piece)))
    secrets.find_secrets(piece + "A" * 200_000 + piece * 50_000)
    assert time.process_time() - start < 8


def test_redaction():
    text = 'my password = "abcdefgh" and token: 0123456789abcdef0123456789abcdef end'
    assert secrets.redact(text, secrets.find_secrets(text)) == 'my [SECRET]" and [SECRET] end'


def test_secrets_over_a_table(spark, clashing, corpus):
    rows = {(r.doc_id, r.base_sha256) for r in secrets.scan_secrets(clashing).collect()}
    assert rows == {(i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in plain_base(t or "")).encode()).hexdigest()) for i, t, *_ in corpus}
    assert secrets.redact_secrets(clashing).count() == len(corpus)
    assert secrets.scan_secrets(clashing.limit(0)).count() == 0


# -- HTML --------------------------------------------------------------------------------------------------------------
LONG = "The quick brown fox is in the house of the old man and it was on the table with a hat for all."
PAGES = {
    f"<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><article><h1>Head &amp; line</h1><p>{LONG}</p><p>Short.</p></article><footer>f</footer>": f"Head & line\n{LONG}\nShort.",
    "<article><p>Hi.<p>Yo<br>lo<br><br>new<div class='comments'><p>reader</div><form>f</form></article><div class='cookie-notice'>c</div>": "Hi.\nYo lo\nnew",
    f"<div class=menu>Home</div><h2>Title here</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p><div><a href=x>link link</a></div><p>copyright</p>": f"{LONG}\nShort.\n{LONG}",
    "<script>var a='</p>';</script><!-- <p>no</p> --><article>a&lt;b &eacute; &#x41;\n\t c</article>": "a<b é A c",
    f"<main><p>{LONG}</p><aside><p>{LONG}</p></aside></main>": LONG,
    "<article><table><tr><td>one</td><td>two</td></tr></table><ul><li>x<li>y</ul></article>": "one\ntwo\nx\ny",
    "<article><p class='lead'>a</p></article><article class='comment'><p>b</p></article>": "a",
    "<head><title>no end of head<body><article><p>kept</p></article>": "kept",
    "": "", "plain text": "", "<": "", "<article>": "", "<article><p>x": "x", f"<p>{LONG}": LONG,
}


@pytest.mark.parametrize("page", list(PAGES))
def test_main_text(page):
    assert html.main_text(page) == PAGES[page]


def test_both_passes_decide_inside_an_article():
    links, keywords = "<div><a href=x>one two three</a> <a href=y>four five six</a></div>", "<p>" + "Berlin Madrid Paris London Rome " * 5 + "</p>"
    paragraphs = f"<p>{LONG}</p>" * 3
    assert html.main_text(f"<article><h1>Head</h1>{paragraphs}{links}<p>Tell friends</p>{links}{paragraphs}<p>End.</p></article>") == "\n".join(["Head", *[LONG] * 6, "End."])
    assert html.main_text(f"<article>{paragraphs}{keywords}{paragraphs}</article>") == "\n".join([LONG] * 6)
    foreign = "Litwo ojczyzno moja ty jestes jak zdrowie ile trzeba cenic ten tylko sie dowie kto stracil"
    assert html.main_text(f"<article><h1>Tytul</h1><p>{foreign}</p></article>") == f"Tytul\n{foreign}"


@pytest.mark.parametrize("tag", "noscript template svg canvas object audio video button select datalist".split())
def test_an_unclosed_element_keeps_the_rest_of_the_page(tag):
    assert html.main_text(f"<{tag}><article><p>kept</p><{tag}><p>too</article>") == "kept\ntoo"
    assert html.main_text(f"<article><p>kept</p><{tag}>gone</{tag}><p>too</article>") == "kept\ntoo"
    assert html.main_text(f"<{tag}><article><p>kept</p><{tag}>gone</{tag}><p>too</article>") == "kept\ntoo"
    assert html.main_text(f"<article><p>kept</p><{tag}><{tag}>gone</{tag}>gone</{tag}><p>too</article>") == "kept\ntoo"
    assert html.main_text("<article><p>kept</p><script>no</article>") == "kept"


ITALIAN = "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita e tanto amara."
CHINESE = "今天天气很好我们一起去公园散步看到了很多美丽的花朵和快乐的孩子们在草地上玩耍大家都很高兴然后我们回家吃晚饭。"
FINNISH = "Mieleni minun tekevi aivoni ajattelevi lähteäni laulamahan saa'ani sanelemahan sukuvirttä suoltamahan lajivirttä laulamahan."
WRAPPED = {
    f'<div class="layout with-sidebar"><article><p>{LONG}</p></article><div class="sidebar"><p>{LONG} x</p></div></div>': LONG,
    f'<div id="page" class="has-header"><p>{LONG}</p><div class="header">{LONG[:80]}</div></div>': LONG,
    f"<form action=x><div class=menu>Home</div><p>{LONG}</p></form>": LONG,
    f"<form><nav>x</nav><article><h1>t</h1><p>{LONG}</p><form>in</form></article></form>": f"t\n{LONG}",
    f"<div class=menu>Home</div><p>{ITALIAN}</p>": ITALIAN,
    f"<div class=menu>首页</div><p>{CHINESE}</p>": CHINESE,
    f"<div class=menu>Etusivu</div><p>{FINNISH}</p>": FINNISH,
    f"<div class=comments><p>{LONG}</p></div><p>{LONG} x</p>": f"{LONG} x",
    f"<article><p>Hi</p></article><div class=comments><article><p>{LONG}</p></article></div>": "Hi",
    f"<div class=no-comments><article><p>{LONG}</p></article></div>": LONG,
}


@pytest.mark.parametrize("page", list(WRAPPED))
def test_what_holds_the_article_is_no_boilerplate(page):
    assert html.main_text(page) == WRAPPED[page]


HOSTILE = ["<a ", '<a "', '<a x="', "<", "<!x", "<!--", "<head>", "<div>", "</p>", "<button>", "<svg", "<script>", "<p class=nav>", "&amp;", '<div class="ad">x', "<title>"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_pages_take_linear_time(piece):
    import time

    start = time.process_time()
    html.main_text(piece * (1_000_000 // len(piece)))
    html.main_text("<div>" * 50_000 + piece * (250_000 // len(piece)))
    assert time.process_time() - start < 12  # 1 MB in some seconds on a slow machine; quadratic time is hours


def plain_text_of(page):
    """The same rules over a tree, each question asked of the whole page anew."""
    from html.parser import HTMLParser

    class Node:
        def __init__(self, tag, attrs, up):
            self.tag, self.up, self.attrs = tag, up, attrs

        def around(self):
            return [self, *(self.up.around() if self.up else [])]

        def why(self):
            if self.tag in ("body", "html", "main"):
                return ""
            names = html.COMMENT_NAMES if self.tag == "article" else html.BAD_NAMES
            found = {w.lower() for k, v in self.attrs if k in ("class", "id") for w in re.findall("[A-Z]?[a-z]+|[A-Z]+", v or "") if w.lower() in names}
            if found & html.READER_NAMES:
                return "reader"
            if self.tag in html.CONTAINERS and not (self.tag == "header" and any(a.tag in ("article", "main") for a in self.around()[1:])):
                return "strict" if self.tag in html.STRICT_TAGS else "layout"
            return "layout" if found else ""

    blocks, state = [], {"at": None, "link": False, "text": []}

    def flush():
        text = " ".join("".join(t for t, _ in state["text"]).split())
        if text:
            linked = len(" ".join("".join(t for t, a in state["text"] if a).split()))
            blocks.append((text, linked, state["at"].around() if state["at"] else []))
        state["text"] = []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a":
                state["link"] = True
            elif tag in html.BLOCK_TAGS:
                flush()
                state["at"] = Node(tag, attrs, state["at"])

        def handle_endtag(self, tag):
            if tag == "a":
                state["link"] = False
            elif tag in html.BLOCK_TAGS:
                flush()
                state["at"] = state["at"].up

        def handle_data(self, data):
            state["text"].append((data, state["link"]))

    Reader().feed(page)
    flush()
    article = lambda nodes: next((a for a in reversed(nodes) if a.tag in ("article", "main")), None)  # noqa: E731  the outermost
    prose = lambda b: len(b[0]) if len(b[0]) >= 70 and b[1] <= 0.33 * len(b[0]) else 0
    total = sum(map(prose, blocks))
    mass = lambda a: sum(len(t) - n for t, n, nodes in blocks if article(nodes) is a)
    articles = {article(nodes) for _, _, nodes in blocks} - {None}
    flagged = lambda nodes: [n for n in nodes if n.why()]
    clean = max((mass(a) for a in articles if not flagged(a.around())), default=0)
    better = [a for a in articles if not a.why() and flagged(a.around()) and mass(a) > clean]
    quiet = [a for a in better if not any(n.why() == "reader" for n in a.around())]
    if quiet:
        better = quiet
    elif clean:
        better = []
    else:
        better = [a for a in better if 2 * sum(prose(b) for b in blocks if flagged(a.around())[0] in b[2]) > total]
    void = {n for a in better for n in a.around()}
    if not clean and not better:
        void = {n for _, _, nodes in blocks for n in nodes if n.why() == "layout" and 2 * sum(prose(b) for b in blocks if n in b[2]) > total}
    bad = [any(n not in void for n in flagged(nodes)) for _, _, nodes in blocks]
    marked = any(article(b[2]) and not x for b, x in zip(blocks, bad, strict=True))
    groups = [article(b[2]) if marked else None for b in blocks]

    def label(i, blind):
        text, linked, _ = blocks[i]
        if bad[i] or (marked and not groups[i]) or linked / len(text) > 0.33:
            return -1
        if len(text) < 70:
            return 0
        if blind:
            return 0 if marked else 1
        words = [w.strip(".,;:!?\"'()").lower() for w in text.split(" ")]
        density = sum(w in html.ALL_STOP_WORDS for w in words) / len(words)
        return 1 if density >= 0.15 else -1 if density < 0.05 else 0

    n = len(blocks)
    labels = [label(i, False) for i in range(n)]
    known = {groups[i] for i in range(n) if labels[i] == 1}
    labels = [labels[i] if groups[i] in known else label(i, True) for i in range(n)]
    out = []
    for i in range(n):
        got = labels[i]
        if got == 0:
            sides = []
            for step in (-1, 1):
                j = i + step
                while 0 <= j < n and groups[j] is groups[i] and (labels[j] == 0 or (marked and bad[j] and article(blocks[j][2]))):
                    j += step
                inside = 0 <= j < n and groups[j] is groups[i]
                sides.append((abs(i - j), labels[j] if inside else 1 if groups[i] else -1))
            (a, x), (b, y) = sides
            got = x if a < b else y if b < a else min(x, y)
        if got == 1:
            out.append(blocks[i][0])
    return "\n".join(out)


def test_pages_equal_the_plain_rules():
    rnd = random.Random(12)
    words = ["the", "of", "and", "house", "river", "walking", "stone", "green", "berlin", "madrid"]

    def text():
        return " ".join(rnd.choice(words[: rnd.choice([3, 10])] if rnd.random() < 0.7 else words[3:]) for _ in range(rnd.choice([1, 3, 8, 25, 60])))

    def element(depth):
        tag = rnd.choice(["div", "div", "section", "article", "main", "aside", "form", "nav", "header", "footer", "ul", "li", "h2"])
        name = rnd.choice(["", "", "", ' class="has-sidebar"', ' class="comment-list"', ' id="page"', ' class="adBox"', ' class="reply"', ' id="menu"'])
        inner = "".join(rnd.choice([lambda: f"<p>{text()}</p>", lambda: text(), lambda: f"<p><a href=x>{text()}</a> {rnd.choice(['', text()])}</p>", lambda: element(depth + 1) if depth < 5 else text()])() for _ in range(rnd.randint(1, 4)))
        return f"<{tag}{name}>{inner}</{tag}>"

    for _ in range(1500):
        page = "".join(element(0) for _ in range(rnd.randint(1, 4)))
        assert html.main_text(page) == plain_text_of(page), page


def test_long_and_deep_pages():
    deep = "<article>" + "<div>" * 3000 + "<p>text here" + "</div>" * 3000 + "</article>"
    assert html.main_text(deep) == "text here"
    many = "<article>" + "".join(f"<p>para {i}" for i in range(20_000))
    assert html.main_text(many).count("\n") == 19_999


def test_pages_over_a_table(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, "<article><p>hé"), (2, None, "<article><p>hé"), (None, "u", "")], "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = sorted(map(tuple, html.extract_text(df).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "hé", 2), (2, None, "hé", 2), (None, "u", "", 0)], key=str)
    assert html.extract_text(df.limit(0)).count() == 0
