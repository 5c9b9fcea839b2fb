"""Operators on documents: brute force, round trips, held-out accuracy, odd rows."""

import base64
import gzip
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidewire.llm import lm_scoring, mixing, near_dedup, packing, quality_classifier, quality_rules, queries, secrets, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


# --- 1


def brute_stats(text):
    w = WORD.findall(text or "")
    where = defaultdict(list)
    for i in range(len(w) - 2):
        where[tuple(w[i : i + 3])].append(i)
    covered = {p + o for ps in where.values() if len(ps) > 1 for p in ps for o in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_on_odd_rows(docs_of, odd):
    rows = [*odd, (20, "a b c a b c a b c"), (21, "x\nx\n\n \nx y"), (22, "a " * 500)]
    got = quality_rules.judge(docs_of(rows, extra=True)).collect()
    found = sorted(((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got))
    assert found == sorted(brute_stats(t) for _, t, *_ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(docs_of([])).collect() == []


def test_equal_hashes_of_other_windows_do_not_count(docs_of):
    """Two million different words leave 43 bits of a hash, of which some windows share all: none of them is a repeat."""
    rows = [(1, " ".join(f"{i:x}" for i in range(6_000_000))), (2, "a b c d a b c")]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.text_stats(docs_of(rows).repartition(2)).collect()}
    assert got == {1: 0, 2: 6}


def test_rules_agree_with_labels(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    got = queries.op1_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) >= 0.95 * len(got)


# --- 2


def check_packing(rows, pieces, length):
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append(p)
    for ps in by.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return len(by)


def test_packing_round_trip(docs_of, odd):
    tokenizer = packing.tokenizer_at(PATH).inner
    got = packing.pack_documents(docs_of(odd, extra=True), PATH, length=64, with_ids=True).collect()
    n = check_packing(odd, got, 64)
    expected = Counter()
    for i, t in odd:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, (a, m) in enumerate(packing.cut(len(ids), 64)):
            expected[i, k, a, m, zlib.crc32(np.array(ids[a : a + m], "<u4").tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in got) == expected
    assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in got)
    assert n <= -(-sum(p.length for p in got) // 64) + 2
    assert packing.pack_documents(docs_of([]), PATH).collect() == []


def test_contract_ids(docs_of, documents):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(PATH)
    rows = [*documents[:100], (9000, "a <|endoftext|> b"), (9001, "<|endoftext|>"), (9002, "x<|endoftext|><|endoftext|> <|endoftext |>")]
    got = {(p.doc_id, p.start): p for p in packing.pack_documents(docs_of(rows), PATH).collect()}
    for i, t in rows:
        ids = [*fresh.encode(t or "", add_special_tokens=False).ids, 0]
        for a, m in packing.cut(len(ids), 2048):
            assert (got[i, a].length, got[i, a].ids_crc32) == (m, zlib.crc32(np.array(ids[a : a + m], "<u4").tobytes()))


def test_tokenizers_agree(documents):
    import pyarrow as pa

    t = packing.tokenizer_at(PATH)
    texts = [x or "" for _, x in documents] + ["", " ", "a  b", "it's\n\nwe'll", "\x1c x", "é" * 5, "日本 語", "<|endoftext|> q", "𝒳 q😀", "٣ ½ ²", "a" * 3000, "  x", "\xa0y"]
    for text, ids in zip(texts, t.encode(pa.array(texts)), strict=True):
        assert t.inner.encode(text, add_special_tokens=False).ids == ids.tolist()


@pytest.mark.parametrize("seed", range(8))
def test_local_search_keeps_all_and_never_loosens(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 1000 if seed % 2 else 2047, 400)
    first = packing.best_fit(sizes, 2048)
    better = packing.improve([list(b) for b in first], sizes, 2048)
    assert sorted(i for b in better for i in b) == list(range(400))
    fills = [int(sizes[b].sum()) for b in better]
    assert max(fills) <= 2048 and len(better) <= len(first)
    assert sum(f * f for f in fills) >= sum(int(sizes[b].sum()) ** 2 for b in first)


def test_exchanges_empty_a_bin():
    sizes = np.array([6, 4, 5, 5, 3, 3, 2, 2])
    bins = packing.improve([[0, 6], [2, 7], [3, 4], [1, 5]], sizes, 10)
    assert len(bins) == 3


# --- 3


def brute_removed(rows, least=50):
    out = []
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        for j in range(len(b) - least + 1):
            first.setdefault(b[j : j + least], math.inf if i is None else i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - least + 1):
            if first[b[j : j + least]] < (math.inf if i is None else i):
                gone[j : j + least] = True
        spans = int((gone & ~np.append(False, gone[:-1])[: len(b)]).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(docs_of, odd, documents):
    rng = np.random.default_rng(3)
    passage = "".join(chr(97 + x) for x in rng.integers(0, 26, 120))
    rows = [*[r for r in odd if r[0] != 5], (30, passage), (31, "head " + passage[:80] + " tail"), (32, passage[10:59]), (33, passage[10:60]), (34, passage + passage), (35, "ab" * 900), (36, "ab" * 40), (37, "é" * 40), (38, "x" + "é" * 40), (None, passage), *[(100 + i, t) for i, t in documents[:60]]]
    got = substring_dedup.remove_repeats(docs_of(rows, extra=True)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_removed(rows)
    assert substring_dedup.remove_repeats(docs_of([])).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_interval_expansion(seed):
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.integers(97, 97 + rng.integers(1, 4) + 1, rng.integers(8, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 12))]
    docs = rng.integers(0, 9, len(texts))
    low = {}
    for t, d in zip(texts, docs, strict=True):
        for j in range(len(t) - 7):
            low[t[j : j + 8]] = min(low.get(t[j : j + 8], 99), int(d))
    for t, w in zip(texts, substring_dedup.least_documents(texts, docs, 8), strict=True):
        assert w.tolist() == [low[t[j : j + 8]] for j in range(len(t) - 7)]


def test_texts_alone_with_their_key_are_not_expanded(monkeypatch):
    rng = np.random.default_rng(5)
    inner = [bytes(rng.integers(97, 123, 60, np.uint8)) for _ in range(4)]
    edges = [inner[0][:10] + inner[1], inner[2][:10] + inner[1]]
    texts, low, tag = [*inner, *edges], np.array([4, 7, 1, 9, 3, 2]), np.array([10, 11, 12, 13, 11, 11])
    whole, expanded = substring_dedup.least_documents(texts, low), []
    plain = substring_dedup.least_windows
    monkeypatch.setattr(substring_dedup, "least_windows", lambda t, d: expanded.extend(t) or plain(t, d))
    lengths, values, n_runs, first_run = substring_dedup.found_runs(pa.array(texts, pa.binary()), low, tag)
    assert sorted(expanded) == sorted([inner[1], *edges])
    for w, n, a in zip(whole, n_runs, first_run, strict=True):
        assert np.repeat(values[a : a + n], lengths[a : a + n]).tolist() == w.tolist()


def test_run_keys_spread_over_buckets():
    """The buckets of keys are of one size, whatever their number."""
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 123, 400_000).astype(np.uint8)
    key, doc, _, _ = substring_dedup.runs(raw, np.arange(0, len(raw) + 1, 1000))
    held = np.diff(substring_dedup._bounds(substring_dedup.chunk_keys(key, doc)[0], 6))
    assert held.max() < 1.5 * held.mean() and held.min() > 0.5 * held.mean()


# --- 4


def test_mix(docs_of, odd):
    rows = [(i, t, s) for k, (i, t) in enumerate(odd) for s in [None if k % 3 == 0 else f"s{k % 3}"]] + [(50 + i, "a b c " * (i + 1), "big") for i in range(40)]
    got = mixing.mix_sources(docs_of(rows, extra=True), bucket_docs=4).collect()
    assert len(got) == len(rows) and sum(r["size"] for r in got) == sum(len(WORD.findall(t or "")) for _, t, _ in rows)
    taken, target = defaultdict(int), {}
    by_size = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source_size, r.target] += r.taken
        by_size[r.source_size, r.target] += r["size"]
    assert all(v == math.floor(k[1]) for k, v in taken.items())
    assert math.isclose(sum(k[1] for k in taken), 1.5 * sum(by_size.values()))
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(docs_of(rows[::-1]), bucket_docs=4).collect()), key=repr)
    assert mixing.mix_sources(docs_of([])).collect() == []
    mixed = mixing.mixed_corpus(docs_of(rows, extra=True)).collect()
    assert sum(len(WORD.findall(r.text)) for r in mixed) == sum(taken.values()) and mixed[0]["size"] == "clash"
    assert mixing.mixed_corpus(docs_of([])).collect() == []


def test_cut_texts_keep_their_lines(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "RANGES", 3)
    text = "  one two\n\nthree\tfour  \x0bfive six\n seven "
    rows = [(i, text, f"s{i % 4}") for i in range(61)]
    plan = {r.doc_id: r for r in mixing.mix_sources(docs_of(rows), bucket_docs=2).collect()}
    by = defaultdict(list)
    for r in mixing.mixed_corpus(docs_of(rows), bucket_docs=2).collect():
        by[r.doc_id].append(r)
    cut = 0
    for i, _, _ in rows:
        whole, rest = divmod(plan[i].taken, 7)
        assert sorted(len(WORD.findall(r.text)) for r in by[i]) == sorted([7] * whole + [rest] * bool(rest))
        for r in by[i]:
            assert text.startswith(r.text) and r.n_chars == len(r.text)
            cut += r.text != text and not r.text[-1].isspace()
    assert cut >= 2


# --- 5


def brute_losses(rows, targets):
    """{row: (tokens, target loss, background loss)}, each row being scored without its own counts."""
    def seq(t):
        w = WORD.findall(t or "")
        return [None, *w, None] if w else []

    u, b, model = [Counter(), Counter()], [Counter(), Counter()], [[0, 1] if i in targets else [0] for i, _ in rows]
    for (_, t), ms in zip(rows, model, strict=True):
        for m in ms:
            u[m].update(seq(t)[1:])
            b[m].update(zip(seq(t), seq(t)[1:], strict=False))
    n = [sum(x.values()) for x in u]
    share, size = (n[1] / n[0] if n[1] else 1, 1), len(u[0]) + 1
    out = []
    for (i, t), ms in zip(rows, model, strict=True):
        s, loss = seq(t), []
        for m in (1, 0):
            own_u, own_b = (Counter(s[1:]), Counter(zip(s, s[1:], strict=False))) if m in ms else (Counter(), Counter())
            total = 0.0
            for h, w in zip(s, s[1:], strict=False):
                alone = (share[m] * (u[m][w] - own_u[w]) + 1) / (share[m] * (n[m] - sum(own_u.values())) + size)
                total -= math.log((share[m] * (b[m][h, w] - own_b[h, w]) + lm_scoring.WEIGHT * alone) / (share[m] * (u[m][h] - own_u[h]) + lm_scoring.WEIGHT))
            loss.append(total / max(1, len(s) - 1))
        out.append((i, max(0, len(s) - 1), *loss))
    return sorted(out, key=repr)


def same_losses(got, expected):
    assert len(got) == len(expected)
    for x, y in zip(sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got), key=lambda r: (repr(r[0]), r[1], -r[3])), sorted(expected, key=lambda r: (repr(r[0]), r[1], -r[3])), strict=True):
        assert x[:2] == y[:2] and np.allclose(x[2:], y[2:], rtol=1e-9, atol=1e-12)


def test_losses(docs_of, odd, documents):
    rows = [(1, "a b a b"), (2, "b a"), (3, None), (4, ""), (5, "c c c"), (1, "a b a b"), (None, "a"), *[(100 + i, t) for i, t in documents[:60]], (80, " ".join(["q"] * 700)), (81, " ".join(f"n{i}" for i in range(3000)))]
    targets = {1, 80, *range(100, 130)}
    got = lm_scoring.cross_entropy_difference(docs_of(rows, extra=True), docs_of([(i, "x") for i in targets] + [(None, "y")])).collect()
    same_losses(got, brute_losses(rows, targets))
    assert all(math.isclose(r.score, r.target_loss - r.background_loss, abs_tol=1e-12) for r in got)
    assert lm_scoring.cross_entropy_difference(docs_of([]), docs_of([])).collect() == []
    with pytest.raises(TypeError):
        lm_scoring.cross_entropy_difference(docs_of(rows).selectExpr("cast(doc_id as string) as doc_id", "text"), docs_of([]))
    got = lm_scoring.cross_entropy_difference(docs_of(rows[:6]), docs_of([])).collect()
    same_losses(got, brute_losses(rows[:6], set()))


def test_losses_over_many_chunks(docs_of, documents, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK", 4000)
    monkeypatch.setattr(lm_scoring, "BUCKET", 9000)
    rows = [*documents[:120], (9000, documents[3][1])]
    targets = {i for i, _ in rows if i % 3 == 0}
    same_losses(lm_scoring.cross_entropy_difference(docs_of(rows), docs_of([(i, "x") for i in targets])).collect(), brute_losses(rows, targets))


def test_two_large_vocabularies_score_apart(docs_of):
    rows = [(1, " ".join(f"a{i % 9000}" for i in range(40_000))), (2, " ".join(f"b{i}" for i in range(40_000))), (3, " ".join(f"a{i % 9000}" for i in range(20_000, 60_000)))]
    got = {r.doc_id: r.score for r in lm_scoring.cross_entropy_difference(docs_of(rows), docs_of([(1, "x")])).collect()}
    assert got[3] < got[2] - 0.5


# --- 6


def test_layers():
    secret = 'token = "abcdef123456"'
    packed = base64.b64encode(zlib.compress((secret + " and more text ") .encode() * 2)).decode()
    zipped = base64.b64encode(gzip.compress(secret.encode() * 2)).decode()
    twice = base64.b64encode(base64.b64encode(b"my secret=zzzzzzzzzz ok then")).decode()
    text = f"x password%3D%22hunter2hunter%22 and {packed} then \\u0070assword: abcdefgh or {twice} {zipped} &#112;asswd=qqqqqqq"
    base, added, _ = secrets.scan_text(text)
    assert not base
    kinds = {k for *_, k in added}
    assert {"url.assign", "base64.zip.assign", "unicode.assign", "base64.base64.assign"} <= kinds
    for a, b, k in added:
        if k == "base64.zip.assign":
            assert text[a:b] in (packed, zipped)
    clean = secrets.redact(text, added)
    assert "hunter2" not in clean and twice not in clean and secrets.scan_text(clean)[1] == []


def test_base_spans(docs_of, odd):
    rows = [*odd, (40, "API_KEY: 'abcdef' passwd=12345 AKIA" + "A" * 16 + " AKIAB " + "0f" * 12 + " g" + "a" * 23), (41, "token token=:x secret = \"aaaaaa\"")]
    got = {(r.doc_id, r.spans): r for r in secrets.find_secrets(docs_of(rows, extra=True)).collect()}
    r = next(v for (i, _), v in got.items() if i == 40)
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 1, 1)
    assert r.base_sha256 == hashlib.sha256(",".join(r.spans.split(",")).encode()).hexdigest()
    assert all(v.base_sha256 == hashlib.sha256(b"").hexdigest() for (i, s), v in got.items() if not s)
    assert secrets.find_secrets(docs_of([])).collect() == []
    plain = {x.doc_id: x for x in secrets.redact_documents(docs_of(rows)).collect()}
    assert plain[40].text.startswith("[secret]' passwd=12345 [secret] AKIAB [secret]") and plain[40].n_chars == len(plain[40].text)
    assert plain[1].text is None and plain[4].text == "one two three"


def test_hint_misses_nothing(documents):
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = [t or "" for _, t in documents]
    hits = pc.match_substring_regex(pa.array(texts), secrets.HINT).to_pylist()
    assert all(h or not (secrets.scan_text(t)[0] or secrets.scan_text(t)[1]) for h, t in zip(hits, texts, strict=True))


def test_hint_and_decoders_reach_the_shortest(docs_of):
    braces = "".join(f"\\u{{{ord(c):x}}}" for c in "password") + "=hunter22"
    texts = [braces, *(base64.b64encode(x).decode() for x in (b"token=abc123", b"secret=abcdefg", b"token:aaaaaa")), b"token=abc123".hex().upper()]
    got = secrets.find_secrets(docs_of(list(enumerate(texts)))).collect()
    assert len(got) == len(texts) and all(r.spans.endswith(f"assign:0:{len(texts[r.doc_id])}") for r in got)
    assert all(r.text == "[secret]" for r in secrets.redact_documents(docs_of(list(enumerate(texts)))).collect())


@pytest.mark.parametrize("width", [20, 64, 76])
def test_wrapped_base64(width):
    def wrap(raw, end="\n"):
        x = base64.b64encode(raw).decode()
        return end.join(x[i : i + width] for i in range(0, len(x), width))

    noise = "".join(chr(33 + x) for x in np.random.default_rng(4).integers(0, 90, 400)).encode()
    for raw in (b"x" * 45 + b" password=hunter2hunter2", gzip.compress(noise + b" password=hunter2hunter2"), zlib.compress(noise + b" token=abc123")):
        for end in ("\n", "\r\n", "\n    "):
            block = wrap(raw, end)
            for text in (block, f"-----BEGIN X-----\n{block}\n-----END X-----\n", f"data: {block}\nand so on"):
                base, added, guarded = secrets.scan_text(text)
                a = text.index(block[:16])
                assert not base and not guarded
                assert any(x <= a and y >= a + len(block) and kind.endswith("assign") for x, y, kind in added)
    cut = base64.b64encode(gzip.compress(b"some plain text " + noise)[:300]).decode()
    assert secrets.scan_text(cut)[2]


def test_streams_are_read_to_the_end(docs_of, monkeypatch):
    two = base64.b64encode(gzip.compress(b"nothing here") + gzip.compress(b" token=abc123")).decode()
    base, added, guarded = secrets.scan_text(two)
    assert [k for *_, k in added] == ["base64.zip.assign"] and not guarded
    monkeypatch.setattr(secrets, "MOST_INFLATED", 1000)
    long = base64.b64encode(zlib.compress(b"word " * 2000 + b"token=abc123 " + b"word " * 900)).decode()
    base, added, guarded = secrets.scan_text(long)
    assert [k for *_, k in added] == ["base64.zip.assign"] and guarded
    monkeypatch.undo()
    bare = base64.b64encode(gzip.compress(bytes(range(32, 127)) * 3)[:-12]).decode()
    assert secrets.scan_text(bare)[1:] == ([], True)
    assert secrets.redact_documents(docs_of([(1, f"a {bare} b")])).first().text == "a [secret] b"


def test_deep_escapes_take_linear_time():
    import time

    for text, kind in (("%" + "25" * 20_000 + "41KIA" + "A" * 20, "nested.access"), ("\\u005c" + "u005c" * 3000 + "u0074oken=abcdef", "nested.assign"), ("&#38;" + "#38;" * 3000 + "#116;oken=abcdef", "nested.assign")):
        began = time.perf_counter()
        base, added, _ = secrets.scan_text(f"head {text} tail")
        assert any(k.endswith(kind) and a == 5 and b == 5 + len(text) for a, b, k in added), kind
        assert time.perf_counter() - began < 5
    assert secrets._collapsed(secrets.Layer("%2%35%32%35c3%a9%2541 %zz &#x26;#65;", None, None, ""), "").text == "éA %zz A"
    deep = b"my token=abcdef99 ok"
    for _ in range(14):
        deep = "".join(f"%{c:02x}" for c in deep).encode() if len(deep) < 4000 else deep
    text = deep.decode()
    base, added, _ = secrets.scan_text(text)
    assert not base and any(k.endswith("assign") for *_, k in added)


def test_other_streams():
    import bz2
    import lzma

    noise = "".join(chr(33 + x) for x in np.random.default_rng(4).integers(0, 90, 300)).encode()
    for pack in (bz2.compress, lzma.compress):
        for raw in (pack(noise + b" token=abc123 "), pack(noise) + pack(b" token=abc123 ")):
            text = base64.b64encode(raw).decode()
            base, added, guarded = secrets.scan_text(text)
            assert [k for *_, k in added] == ["base64.zip.assign"] and not guarded and added[0][0] == 0


def scanned_by_hand(text):
    """Base spans by a search from each place, without the operator's patterns."""
    low, found = text.lower(), []
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    i = 0
    while i < len(text):
        hit = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, i) and text[i : i + len(word)].isascii():
                j = i + len(word)
                j += text[j : j + 1] in ("'", '"') and bool(text[j : j + 1])
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "="):
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                starts = [j + 1, j] if text[j : j + 1] in ("'", '"') and text[j : j + 1] else [j]
                for k in starts:
                    e = k
                    while e < len(text) and text[e] in value:
                        e += 1
                    if e > k:
                        hit = (i, e, "assign", e - k >= 6)
                        break
                if hit:
                    break
        if hit:
            if hit[3]:
                found.append(hit[:3])
            i = hit[1]
        else:
            i += 1
    for kind, chars, head, least in (("access", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), "AKIA", 20), ("hex", set("0123456789abcdef"), "", 24)):
        i = 0
        while i < len(text):
            e = i
            if text.startswith(head, i):
                e = i + len(head)
                while e < len(text) and text[e] in chars:
                    e += 1
                if e - i < len(head) + 1:
                    e = i
            if e - i >= least:
                found.append((i, e, kind))
            i = max(e, i + 1)
    return sorted(found, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_base_results_on_all_rows(docs_of, documents, spark, sf_dir):
    extra = ["x Token: 'token=abcdefg", "api_key==abcdef", "password''=abcdef", "secret = token = abcdefgh", "passwd=abc token=abcdef", "AKIAAKIA" + "A" * 12, "f" * 23 + " " + "0a" * 13, "K" + "apikey:'abcde.", "sec\u212aet=abcdef", "to\u212aen=abcdef"]
    rows = [*documents, *[(10**6 + i, t) for i, t in enumerate(extra)]]
    got = {r.doc_id: r for r in secrets.find_secrets(docs_of(rows)).collect()}
    for i, t in rows:
        spans = scanned_by_hand(t or "")
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == kind for *_, k in spans) for kind in secrets.KINDS], (i, t[:200])
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()


# --- 7


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    scored = queries.op7_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.95 * len(scored)


def test_classifier_on_odd_rows(spark, docs_of, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(docs_of(odd, extra=True), none).collect()
    assert len(got) == len(odd) and all(r.score == 0.5 and r.predicted == 1 for r in got)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 0), (7, 0, 0), (8, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(docs_of(odd), labels).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id == 4] == [zlib.crc32(b"4") % 3 == 1] * 2
    assert quality_classifier.classify(docs_of([]), labels).collect() == []


def test_rule_column_is_the_fitted_score(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, len(quality_classifier.FEATURES)))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    rules = quality_classifier.fit_rules(x, y)
    total = np.full(len(x), rules.bias)
    for conditions, weight in rules.rules:
        total += weight * quality_classifier._holds(x, conditions)
    df = spark.createDataFrame(x.tolist(), ", ".join(f"f_{f} double" for f in quality_classifier.FEATURES)).select(rules.column().alias("s"))
    found = np.array([r.s for r in df.collect()])
    assert np.allclose(found, 1 / (1 + np.exp(-total))) and ((found >= 0.5) == y).mean() > 0.97


# --- 9


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("small", [2048, 6])
def test_near_copies(docs_of, odd, documents, small, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    copies = []
    for i in range(40):
        w = list(words)
        for k in rng.integers(0, 200, i % 5):
            w[k] = f"z{i}"
        copies.append((500 + i, " ".join(w)))
    rows = [*odd, *documents[:80], *copies, (600, "A b C d e"), (601, "a B c d E")]
    got = near_dedup.near_duplicates(docs_of(rows, extra=True)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("collected", [1 << 17, 0])
def test_components_of_few_and_many_links(spark, collected, monkeypatch):
    """Few links take no stages of stars; either way a chain, a ring and a star get their least members."""
    monkeypatch.setattr(near_dedup, "MOST_COLLECTED", collected)
    tables, plain = [], near_dedup.staged
    monkeypatch.setattr(near_dedup, "staged", lambda df, name="stage": tables.append(name) or plain(df, name))
    rng = np.random.default_rng(2)
    chain, ring, star = (100 * k + rng.permutation(40) for k in (1, 2, 3))
    links = [*zip(chain, chain[1:]), *zip(ring, np.roll(ring, 1)), *((star[0], x) for x in star[1:]), (7, 7 + (1 << 40)), (chain[3], chain[9])]
    got = near_dedup.components(spark.createDataFrame([(int(a), int(b)) for a, b in links], "a long, b long")).collect()
    want = {**{int(x): int(g.min()) for g in (chain, ring, star) for x in g}, 7: 7, 7 + (1 << 40): 7}
    assert len(got) == len(want) and {r.uid: r.root for r in got} == want
    assert bool(tables) == (not collected)


@pytest.mark.parametrize("deep", [12, 2])
def test_chains_from_a_large_group(docs_of, deep, monkeypatch):
    """Hub, D and E: similar from one to the next only. The group spans many blocks, in which few have met E."""
    monkeypatch.setattr(near_dedup, "SMALL", 16)
    monkeypatch.setattr(near_dedup, "DEEP", deep, raising=False)
    hub = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*hub, f"h{i}"])) for i in range(300)]
    for k in range(12):
        d = [*hub[:50], *(f"d{k}x{i}" for i in range(15)), *hub[65:]]
        e = [*d[:120], *(f"e{k}x{i}" for i in range(15)), *d[135:]]
        rows += [(1000 + k, " ".join([*d, f"d{k}"])), (2000 + k, " ".join([*e, f"e{k}"]))]
    got = near_dedup.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {0}


@pytest.mark.parametrize("n", [50, 200])
def test_large_mixed_groups(docs_of, n, monkeypatch):
    """Texts that share a passage but are alike in pairs only: a group of bounded size takes no further level."""
    monkeypatch.setattr(near_dedup, "SMALL", 16)
    tables, plain = [], near_dedup.staged
    monkeypatch.setattr(near_dedup, "staged", lambda df, name="stage": tables.append(name) or plain(df, name))
    common = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*common, *(f"own{i // 2}x{k}" for k in range(40)), f"last{i}"])) for i in range(n)]
    got = near_dedup.near_duplicates(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)
    assert "links-1" in tables and ("nodes-1" in tables) == (n == 200)


@pytest.mark.parametrize("most", [1 << 22, 300])
def test_units_of_many_shingles(docs_of, most, monkeypatch):
    """Units that hold more shingles than a task may still compare all of their pairs, however few select the texts."""
    monkeypatch.setattr(near_dedup, "MOST_SHINGLES", most)
    monkeypatch.setattr(near_dedup, "MOST_BROADCAST", 10 if most == 300 else 1_000_000)
    chain = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*(f"z{k}" for k in range(4 * i)), *chain[4 * i :]])) for i in range(12)]
    got = near_dedup.near_duplicates(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)


def test_near_copies_edges(docs_of):
    assert near_dedup.near_duplicates(docs_of([])).collect() == []
    kept = near_dedup.keep_first(docs_of([(2, "a b c d e f"), (2, "a b c d e f"), (1, "A b c d e f"), (3, None), (4, "")], extra=True)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4] and kept[0]["size"] == "clash"
