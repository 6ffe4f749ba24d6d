"""The llm operators against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import same
from pyspark.sql import functions as F

from spanwise.llm import chat, licences, neardup, packing, pieces, pii, quality, registry, search, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **more):
    df = spark.createDataFrame([(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)], DOCS)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


ODD = [None, "", " \n\t ", "a", "x" * 50_000, "word " * 3000, "Ünï ☃ 𝒳     end", "same text here now", "same text here now"]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck, registry.ORACLE_SQL[name])


# --- op1 -------------------------------------------------------------------------------------------------------------


def every_segmentation(model, s):
    if not s:
        return [(0.0, ())]
    out = []
    for end, score, ids in model.edges(s, 0):
        out += [(score + x, ids + i) for x, i in every_segmentation(model, s[end:])]
    return out


@pytest.mark.parametrize("text", ["hello world", "Éa ñandú x", "the 日本\n", "a  b", "▁ x", " lead", "ééé 𝒳", "aaaa", ""])
def test_n_best_is_exact(text):
    m = pieces.load(pieces.default_path())
    got = m.encode(text, 5)
    brute = sorted((x for x, _ in every_segmentation(m, "".join(pieces.cut(text)))), reverse=True)
    assert [x for x, _ in got] == brute[: len(got)] and len(got) == min(5, len(brute))
    assert len({i for _, i in got}) == len(got)
    for score, ids in got:
        k = np.frombuffer(ids, "<u4")
        assert pieces.surface(pieces.default_path()).decode(k) == text.replace("▁", " ")
    assert m.encode(text, 1) == got[:1]


def test_parts_that_share_windows_are_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

    m = pieces.Model(pieces.default_path())
    m.known = Counted(m.known)
    some = ["zqx", "vkj", "☃wq", "jxq"]
    text = " ".join(a + b + c + d for a in some for b in some for c in some for d in some)
    got = m.encode(text)
    # A few look-ups for a window that is new, none for one that was seen; one by one it is two a character at least.
    assert m.known.asked < len(text)
    assert got == pieces.Model(pieces.default_path()).encode(text) and len(m.parts) == 256


def test_pieces_on_odd_texts(spark):
    got = pieces.encode_documents(documents(spark, ODD, scores=1, decoded="x"), pieces.default_path()).collect()
    assert len(got) == len(ODD) and all(r.decoded for r in got)
    assert got[0].n_pieces == 0 and got[7].ids_sha256 == got[8].ids_sha256
    m = pieces.load(pieces.default_path())
    some = [None, "", "Ünï ☃ 𝒳     end", "same text here now"]
    docs = documents(spark, some, ids="x", decoded=1)
    rows = pieces.encode(docs, pieces.default_path(), 3)
    for r in rows.collect():
        want = m.encode(r.text or "", 3)
        assert (r.scores, r.ids, r.n_pieces) == ([x for x, _ in want], [np.frombuffer(i, "<u4").tolist() for _, i in want], len(r.ids[0]))
        digests = [hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in r.ids]
        assert pieces.encode_documents(docs.where(F.col("doc_id") == r.doc_id), pieces.default_path(), 3).first().ids_sha256 == digests
    back = pieces.decode(rows.select("doc_id", F.get("ids", F.size("ids") - 1).alias("ids")), pieces.default_path()).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == [x or "" for x in some]
    assert pieces.encode_documents(docs.where("false"), pieces.default_path()).count() == 0


# --- op2 -------------------------------------------------------------------------------------------------------------


def plain_base(text):
    """The contract's patterns by the regex engine, without any short cut."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(3)
    parts = ["a@b.c", "@", "x@y", ".", "..", "1", "10", "255", "256", ".1", "+1", "+", " ", "-", "(456) 555-2186", "4111111111111111", "4111-1111 1111 1111", "é", "a%b@c-d.e.f@g.h", "1.2.3.4.5.6", "\n", "²", "٣", "00000000000000"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(1, 12)))
        assert pii.base_spans(text) == plain_base(text), text
    assert pii.base_spans("9" * 100_000 + "." * 10 + "+1" * 1000) is not None


def test_skip_links_carry_labels(spark):
    rng = np.random.default_rng(0)
    phone = lambda: f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
    train = [f"words here {phone()} and 4.0 more words version 2.0 of it 12 times" for _ in range(150)] + [f"from 10.0.{k}.7 to me{k}@mail.example.com at 3.1 again" for k in range(100)]
    field = pii.train(documents(spark, train))
    assert (field.skip >= 0).all()
    text = "call +1 (456) 555-2186 now. Later, ring 1-456-555-2186, not version 2.0."
    text = text.replace("1-456-555-2186", "(456) 555-2186")
    base = pii.base_spans(text)
    added = pii.added_spans(text, base, field)
    assert len(base) == 1 and [text[s:e] for _, s, e in added][0].endswith("555-2186")
    assert pii.added_spans("version 2.0 and 12 times", [], field) == []
    docs = documents(spark, ["mail a.b@c.example.org or +1 (456) 555-2186!", *ODD], spans="x", base_sha256=1)
    got = pii.redacted(docs, field).orderBy("doc_id").collect()
    assert got[0].text == "mail [EMAIL] or [PHONE]!" and got[0].n_chars == len(got[0].text)
    assert [r.text for r in got[1:]] == ODD
    found = pii.find(docs, field).orderBy("doc_id").collect()
    assert (found[0].n_email, found[0].n_phone) == (1, 1)
    assert found[1].base_sha256 == hashlib.sha256(b"").hexdigest() and found[1].spans == ""


def every_marginal(field, g):
    """Marginals by the sum over all labellings."""
    n, k = len(g.spans), pii.OTHER + 1
    total, out = 0.0, np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        if any(c >= 0 and c != y for c, y in zip(g.clamped, labels, strict=True)):
            continue
        score = sum(field.unary[g.features[i], y].sum() for i, y in enumerate(labels))
        score += sum(field.chain[labels[a], labels[b]] for a, b in g.chain)
        score += sum(field.skip[labels[a]] for a, b in g.skip if labels[a] == labels[b])
        weight = math.exp(score)
        total += weight
        out[range(n), labels] += weight
    return out / total


def test_beliefs_are_exact_on_trees_and_close_on_loops():
    rng = np.random.default_rng(7)
    field = pii.Field(rng.normal(0, 0.3, (pii.HASHED + 1, pii.OTHER + 1)), rng.normal(0, 0.5, (pii.OTHER + 1, pii.OTHER + 1)), rng.uniform(0, 1.5, pii.OTHER + 1))
    chain = pii.Graph("a 12 34 b 5551234 c 5551234", [])
    assert chain.chain == [(0, 1)] and chain.skip == [(2, 3)]
    got, settled = field.beliefs(chain)
    assert settled and np.abs(got - every_marginal(field, chain)).max() < 1e-6
    held = pii.Graph("call +1 (456) 555-2186 or 5552186", pii.base_spans("call +1 (456) 555-2186 or 5552186"))
    got, _ = field.beliefs(held)
    assert np.abs(got - every_marginal(field, held)).max() < 1e-6
    loop = pii.Graph("5551234 6661234 x 5551234 6661234", [])
    assert len(loop.chain) == 2 and len(loop.skip) == 2
    got, settled = field.beliefs(loop)
    assert settled and np.abs(got - every_marginal(field, loop)).max() < 0.05


def test_second_mentions_are_found(spark):
    """A mention that no pattern finds, beside one that a pattern does; and secrets, also without the word before. Recall by kind."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    some = lambda n: " ".join(word() for _ in range(n))
    number = lambda: f"{rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    train = []
    for _ in range(250):
        tel, mail, token = number(), f"{word()}.{rng.integers(1, 99)}@mail{rng.integers(9)}.example.com", key()
        train.append(f"{some(8)} +1 ({tel} {some(5)} {mail} {some(5)} +1 ({tel} {some(3)} {mail} version 2.0 of {rng.integers(1, 99)} {some(3)} token = \"{token}\" {some(3)}")
        train.append(f"{some(5)} {rng.integers(10**7, 10**8)} {some(4)} {rng.integers(10**7, 10**8)} {some(3)} 3.14 {some(3)}")
    field = pii.train(documents(spark, train))
    hit, asked, wrong = {}, {}, 0
    for _ in range(60):
        tel, name, token = number(), f"{word()}.{rng.integers(1, 99)}", key()
        for kind, text, second in (
            ("phone", f"{some(4)} +1 ({tel} {some(6)} ({tel} {some(3)}", f"({tel}"),
            ("email", f"{some(4)} {name}@mail3.example.com {some(6)} {name}@mail3 {some(3)}", f" {name}@mail3 "),
            ("secret", f"{some(4)} token = \"{token}\" {some(3)}", token),
        ):
            found = pii.added_spans(text, pii.base_spans(text), field)
            asked[kind] = asked.get(kind, 0) + 1
            at = text.rindex(second.strip())
            hit[kind] = hit.get(kind, 0) + any(pii.LABELS[k] == kind and s < at + len(second.strip()) and e > at for k, s, e in found)
        wrong += bool(pii.added_spans(f"{some(5)} {rng.integers(10**7, 10**8)} {some(4)} version 2.0 {some(3)}", [], field))
    recall = {k: hit[k] / n for k, n in asked.items()}
    assert min(recall.values()) >= 0.9 and wrong <= 3, (recall, wrong)


def test_pii_on_empty_tables(spark):
    docs = documents(spark, ["x"]).where("false")
    assert pii.find(docs, pii.train(docs)).count() == 0


# --- op3 -------------------------------------------------------------------------------------------------------------


def test_machine_learns_a_pair_that_weights_miss():
    a, b, c = 5, 9, 12
    rows = [(a,), (b,), (a, b), (c,), (a, c), (b, c), ()]
    lists = [np.array(r, np.int64) for r in rows for _ in range(60)]
    labels = np.array([int(r == (a, b)) for r in rows for _ in range(60)])
    m = toxicity.fit(lists, labels)
    place = {int(k): i for i, k in enumerate(m.inputs)}
    score = lambda r: m.score([place[k] for k in r if k in place])
    assert score((a, b)) > 0.7 > max(score(r) for r in rows if r != (a, b))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.query(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    toxic, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in clean) / len(clean) < 0.01
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.7


def test_toxicity_odd_rows(spark):
    docs = documents(spark, ODD, score=1, _score=2, toxic=3)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    kept = toxicity.kept_documents(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    assert toxicity.kept_documents(docs, labels).count() <= len(ODD)


# --- op4 -------------------------------------------------------------------------------------------------------------


def shingle_set(text, width):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(texts, width):
    sets = [shingle_set(t, width) for t in texts]
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((comp[a], comp[b]))
            comp = [x if c == y else c for c in comp]
    return [(k, len(sets[k]), comp[k]) for k in range(len(texts))]


@pytest.mark.parametrize("width", [4, 5])
def test_neardup_against_brute_force(spark, width):
    rng = np.random.default_rng(width)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = list(ODD)
    for n in (3, 8, 20, 60, 200):
        for _ in range(4):
            base = list(rng.choice(vocabulary, n))
            texts.append(" ".join(base))
            chain = base
            for _ in range(4):  # copies of copies: linked only through each other
                chain = list(chain)
                for _ in range(max(1, n // 40)):
                    chain[rng.integers(len(chain))] = str(rng.choice(vocabulary))
                texts.append(" ".join(chain).upper() if rng.random() < 0.3 else "  ".join(chain))
    got = neardup.resolve(documents(spark, texts, n_shingles=1, component_id="x", kept=0), width).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == brute_components(texts, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_neardup_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in neardup.resolve(docs).collect())
    assert got == [(-1, None, True), (2, 2, True), (2, 2, True), (3, 2, False)]
    assert neardup.resolve(docs.where("false")).count() == 0
    assert neardup.kept_documents(documents(spark, ["a b c d e f", "A b c d e f", "other"], _gone=1)).count() == 2


def test_neardup_rows_that_repeat_a_doc_id(spark):
    """Each row is a document: a text without a copy stays, of exact copies one row does."""
    a, b, z = ("one two three four five six seven", "b c d e f g h i j k l m", "z y x w v u t s")
    rows = [(1, b, 0), (5, a, 0), (5, b, 0), (7, z, 0), (7, z, 0), (9, None, 0), (9, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int")
    kept = neardup.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, b), (5, a), (7, z), (9, ""), (9, "")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.resolve(docs).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 7, True), (7, 7, True), (9, 9, True), (9, 9, True)]


def test_neardup_across_blocks(spark, monkeypatch):
    """Chains whose neighbours link and whose ends don't, in blocks of a few members; a hub that few of them resemble."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(3):
        chain = list(rng.choice(words, 40))
        for step in range(25):
            texts.append(" ".join(chain))
            chain = list(chain)
            chain[(7 * step) % 40] = f"x{rng.integers(10**6)}"
            if step % 3 == 2:
                chain[(7 * step + 3) % 40] = f"y{rng.integers(10**6)}"
    order = rng.permutation(len(texts))
    texts = [texts[k] for k in order]
    got = neardup.resolve(documents(spark, texts), 4).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == brute_components(texts, 4)


def test_neardup_recall_near_the_threshold(spark):
    """Pairs whose similarity is just over 0.8 are all found."""
    rng = np.random.default_rng(12)
    texts = []
    for n in (60, 200, 800):
        for _ in range(60):
            base = [f"v{x}" for x in rng.integers(0, 10**6, n)]
            cut = max(1, int(0.11 * n))
            texts += [" ".join(base), " ".join(base[:-cut] + [f"u{x}" for x in rng.integers(0, 10**6, cut)])]
    want = brute_components_of_pairs(texts, 4)
    assert sum(c != k for k, c in want) > 100
    got = neardup.resolve(documents(spark, texts), 4).orderBy("doc_id").collect()
    assert [(r.doc_id, r.component_id) for r in got] == want


def brute_components_of_pairs(texts, width):
    """Components of texts that can only link with the one beside them."""
    sets = [shingle_set(t, width) for t in texts]
    linked = [100 * len(sets[k] & sets[k ^ 1]) >= 80 * len(sets[k] | sets[k ^ 1]) for k in range(len(texts))]
    return [(k, k & ~1 if linked[k] else k) for k in range(len(texts))]


def test_estimates_are_close():
    rng = np.random.default_rng(1)
    for n in (5, 50, 2000):
        err = []
        for _ in range(40):
            u = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(u[:n]), np.unique(u[n // 5 : n + n // 5])
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            s = neardup.sketches([a, b])
            err.append(neardup.estimate(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]))[0] - j)
        assert abs(np.mean(err)) < 0.05 and np.abs(err).max() < 0.3


# --- op5 -------------------------------------------------------------------------------------------------------------


def test_tokens_equal_whole_text_encoding():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_path())
    texts = ["Hello  World's\n\tfoo <|endoftext|> é 12", "", "Eaea\x1cfoo İstanbul ΟΔΟΣ é \n̸x don't. a.b, x||y ** !!", "ǅ ﬁ Å ſ K's ... 'tis I'll.  q", "x" * 3000, *[x or "" for x in ODD]]
    for text, got in zip(texts, packing.encoded(texts, packing.default_path()), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


def plain_bound(lengths, capacity):
    """Martello and Toth's second bound, by its definition."""
    best = 0
    for a in range(capacity // 2 + 1):
        big = [x for x in lengths if x > capacity - a]
        wide = [x for x in lengths if capacity // 2 < x <= capacity - a]
        small = [x for x in lengths if a <= x <= capacity // 2]
        best = max(best, len(big) + len(wide) + max(0, -(-(sum(small) - len(wide) * capacity + sum(wide)) // capacity)))
    return best


def test_bound_equals_its_definition_and_no_packing_goes_below():
    rng = np.random.default_rng(6)
    for top in (12, 40, 100):
        for n in (0, 1, 5, 40):
            lengths = rng.integers(1, top + 1, n).tolist()
            h = {x: lengths.count(x) for x in lengths}
            assert packing.fewest(h, top) == plain_bound(lengths, top) >= -(-sum(lengths) // top)
            assert sum(k for _, k in packing.best_fit(h, top)) >= packing.fewest(h, top)


def test_tokens_are_right_when_words_are_forgotten(monkeypatch):
    """Blocks that overflow the memory of words: each word is learned again when it comes again."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "HELD", 3000)
    monkeypatch.setattr(packing, "TOGETHER", 50)
    t = Tokenizer.from_file(packing.default_path())
    rng = np.random.default_rng(8)
    some = ["And", "and", "And,", "e1", "x.", "Über", "?!", "it's", *[f"w{chr(97 + k)}{chr(97 + j)}" for k in range(26) for j in range(8)]]
    texts = [" ".join(rng.choice(some, rng.integers(0, 30))) for _ in range(300)]
    for text, got in zip(texts, packing.encoded(texts, packing.default_path()), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


def test_packing_is_gapless_and_tight(spark):
    texts = ["some words " * int(k) for k in np.random.default_rng(0).integers(0, 900, 120)] + ODD
    got = packing.pack(documents(spark, texts, sequence_id=1, piece="x", rank=2), packing.default_path()).collect()
    whole = dict(zip(range(len(texts)), packing.encoded([t or "" for t in texts], packing.default_path()), strict=True))
    by = {}
    for r in got:
        part = whole[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert r.ids_crc32 == zlib.crc32(part) and r.start == 2048 * r.piece and len(part) == 4 * r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(x) // 4 for x in whole.values())
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= plain_bound([r.length for r in got], 2048) + 1
    assert packing.pack(documents(spark, ["x"]).where("false"), packing.default_path()).count() == 0


def test_local_search_empties_bins():
    assert len(packing.local_search([[6, 5], [7, 4], [4, 4], [3, 3]], 12)) == 3
    rng = np.random.default_rng(5)
    for _ in range(10):
        h = {int(k): int(n) for k, n in zip(rng.integers(1, 2049, 60), rng.integers(1, 30, 60), strict=True)}
        plan = packing.plan(h)
        used = {}
        for pattern, n in plan:
            assert sum(pattern) <= 2048
            for x in pattern:
                used[x] = used.get(x, 0) + n
        assert used == h and sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(h, 2048))


# --- op6, op9, op10 --------------------------------------------------------------------------------------------------


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software. The above copyright notice and this permission notice shall be included in all copies. THE SOFTWARE IS PROVIDED \"AS IS\", without warranty of any kind, express or implied."
    texts = [*ODD, "x\nLicensed under the Apache License, Version 2.0.", mit, "Released under the MIT License. Licensed under CC BY-NC 4.0."]
    got = licences.scan(documents(spark, texts, licences="x", _seq=1)).orderBy("doc_id").collect()
    assert [r.licences for r in got[-3:]] == ["Apache-2.0", "MIT", "MIT,CC-BY-NC-4.0"] and [r.n_matches for r in got[-3:]] == [1, 1, 2]
    assert all(r.licences == "" and r.n_matches == 0 for r in got[:-3])


def brute_counts(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    at = {}
    for k in range(len(w) - 2):
        at.setdefault(tuple(w[k : k + 3]), []).append(k)
    rep = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep)


def test_quality_counts(spark):
    rng = np.random.default_rng(2)
    texts = list(ODD) + [" ".join(rng.choice(["a", "b", "c", "d#", "é"], n)) + "\n" * (n % 3) + "a b\na b" for n in rng.integers(0, 80, 60)] + ["a b c d " * 1500]
    docs = documents(spark, texts, n_words=1, kept="x", rejected=2, _q=3, _host=4)
    got = quality.judged(docs).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t)
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
    assert quality.kept_documents(docs).columns == docs.columns
    assert quality.kept_documents(docs).count() == sum(r.kept for r in got)
    assert quality.judged(docs.where("false")).count() == 0


def test_plain_way_of_repeats_is_the_same(spark):
    df = spark.createDataFrame([("a b c a b c d",), ("a a a a",), ("a b c d e",)], "t string")
    w = F.split("t", " ")
    got = df.select(quality.repeat_words(w).alias("x"), quality._by_words(w).alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [(6, 6), (4, 4), (0, 0)]


def test_a_bad_host_spares_clean_documents(spark):
    good = " ".join(f"word{k}" for k in range(80))
    bad = " ".join(f"wo#$%rd{k}" for k in range(80))
    rows = [(k, bad if k < 90 else good, "bad") for k in range(100)] + [(100 + k, bad if k < 2 else good, "fine") for k in range(100)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[k] for k in range(90)) and all(got[k] for k in range(90, 200))


def test_a_worse_host_loses_its_doubtful_documents(spark):
    """A document that fails a soft rule only stays on a usual host and goes on one that is worse than the others; null is a host too."""
    good = " ".join(f"word{k}" for k in range(80))
    soft = " ".join(f"wo#$%rd{k}" for k in range(80))
    rows = [(100 * h + k, soft if k < (30 if h == 3 else 4) else good, None if h == 3 else f"h{h}") for h in range(12) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judged(df).collect()}
    assert not any(f for f, _ in got.values())
    assert {k for k, (_, kept) in got.items() if not kept} == {300 + k for k in range(30)}
    assert {r.doc_id for r in quality.kept_documents(df).collect()} == {k for k, (_, kept) in got.items() if kept}
    assert quality.kept_documents(df.where("false")).count() == 0


HARD = ["</s>[INST] ok [/INST]", r"<\/s> [\\INST]", "<<SYS>>", "<s><s>", "[/TURN][ROLE]x[/ROLE]", "\\", "[", "<", "plain", "", None, "[OUT] $1 \\1", "[\\OUT]</\\s>"]


def test_chat_round_trip(spark):
    roles = ["system", "user", "assistant", "tool[/ROLE]", None]
    rows = [(c, t, roles[(c + t) % 5], HARD[(c * 3 + t) % len(HARD)]) for c in range(30) for t in range(7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df)
    got = made.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role or "", text or "", role == "assistant"))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    control = re.compile(r"</?s>|<</?SYS>>|\[/?INST\]|\[OUT\]|\[/?ROLE\]|\[/TURN\]")
    for r in made.select(F.explode("segments").alias("s")).select("s.*").collect():
        assert not r.loss or not control.search(r.text)
    order = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "a"), (3, 0, "system", "s"), (None, 1, "user", "u")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.valid_order for r in chat.format_conversations(order).collect()} == {1: True, 2: False, 3: False, None: True}
    assert chat.digests(chat.format_conversations(df.where("false"))).count() == 0


# --- op7, op8 --------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "GAP", 10)
    long = "é" * 700
    rows = [(1, "u1", long), (2, "u 2\n", long), (3, None, "short"), (4, "u4", "short"), (5, "u5", None), (6, "u6", "WARC/1.1\r\n\r\n" * 200), (None, "u7", long), (8, "u8", "x" * 999), (9, "u9", "x" * 999)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    index = warc.write_archives(pages)
    assert set(index.columns) >= {"offset", "length", "url", "digest"} and index.count() == len(rows)
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    for page, _, html in rows:
        data = (html or "").encode()
        r = got[page]
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest()
        assert r.record_type == ("revisit" if page in (1, None) else "response") and r.refers_to == (2 if page in (1, None) else None)
        assert r.payload == (b"" if page in (1, None) else data)
    monkeypatch.setattr(warc, "RUN", 300)
    again = spark.createDataFrame([(1, "u", long, 0), (1, "u", long, 0), (2, "v", "abc" * 500, 0), (2, "v", None, 0)], "page_id long, url string, html string, digest int").coalesce(1)
    small = warc.write_archives(again)
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.read_records(small).collect()) == [(1, 1400, "response"), (1, 1400, "response"), (2, 0, "response"), (2, 1500, "response")]
    one = warc.read_records(index.where("page_id in (3, 6)"))
    assert {r.page_id for r in one.collect()} == {3, 6}
    assert warc.write_archives(pages.where("false")).count() == 0


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    for n, m, d in ((700, 40, 8), (1500, 60, 64), (50, 50, 3)):
        x = np.floor(64 * rng.normal(0, 0.1, (n, d)))
        x[: n // 3] = x[0]
        ids = rng.permutation(n) * 3
        got = search.top_k(ids[:m], x[:m], ids, x)
        want = [(int(a), i, -s) for a, v in zip(ids[:m], x[:m], strict=True) for s, i in sorted((-int(v @ y), int(i)) for y, i in zip(x, ids, strict=True) if i != a)[:20]]
        assert sorted(got) == sorted(want)


def test_cover_tree_of_points_apart_is_built_in_few_passes():
    """Points that all lie apart: trying each as a centre would pass over all points some thousand times."""
    x = np.floor(64 * np.random.default_rng(2).normal(0, 0.15, (6000, 64)))

    def seconds(f, *args):
        began = time.process_time()
        f(*args)
        return time.process_time() - began

    one = min(seconds(lambda: [((x - x[0]) ** 2).sum(1) for _ in range(20)]) for _ in range(3)) / 20
    assert seconds(search.CoverTree, x) < 600 * one
    tree = search.CoverTree(x)
    assert sorted(tree.order.tolist()) == list(range(len(x)))


def test_archives_roll_over_and_long_records(tmp_path, monkeypatch):
    """Archives end at their size, a record longer than a range is one of its own, and names never repeat."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 400)
    rng = np.random.default_rng(0)
    rows = [(k % 5, f"u{k}", bytes(rng.integers(0, 256, 300 if k % 4 else 3000, dtype=np.uint8)), None) for k in range(12)] + [(3, "r", None, 99)]
    batch = pa.RecordBatch.from_pylist([{"page_id": p, "url": u, "payload": b, "size": len(b or b"abc"), "digest": hashlib.sha1(b or b"abc").hexdigest(), "refers_to": r} for p, u, b, r in rows])
    index = [r for out in warc._write(str(tmp_path), iter([batch])) for r in out.to_pylist()]
    assert len({r["archive"] for r in index}) > 3 and len(index) == len(rows)
    names = set()
    for r, (page, url, payload, refers) in zip(index, rows, strict=True):
        with open(r["archive"], "rb") as f:
            f.seek(r["offset"])
            data = f.read(r["length"])
        got = warc.parse(data)
        assert (got["page_id"], got["url"], got["payload"], got["refers_to"]) == (page, url, payload or b"", refers)
        assert got["payload_bytes"] == len(payload or b"abc") and got["payload_digest"] == r["digest"]
        names.add(re.search(rb"WARC-Record-ID: <(urn:uuid:[^>]+)>", zlib.decompress(data, 31)).group(1))
    assert len(names) == len(rows)


def test_empty_tables_of_the_others(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    none = documents(spark, ["x"]).where("false")
    assert toxicity.kept_documents(none, labels).count() == 0
    assert toxicity.with_score(documents(spark, ODD), toxicity.train(none, labels)).where("_score < 0.01").count() == len(ODD)
    assert licences.scan(none).count() == 0
    # Ids with one label each, and none of them a document.
    assert toxicity.kept_documents(documents(spark, ODD), spark.createDataFrame([(100, 1)], "doc_id long, toxic int")).count() == len(ODD)


def test_chat_turns_that_repeat_and_tie(spark):
    """Repeated rows are repeated turns; tied turns stand by role and text."""
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 1, "assistant", "c"), (1, 1, "assistant", "c"), (1, None, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df).select(chat.parse(F.col("formatted")).alias("turns")).first().turns
    assert sorted((t[0], t[1]) for t in got) == sorted((r, t) for _, _, r, t in rows)
    tied = [(t[0], t[1]) for t in got if t[0] != "system"]
    assert tied == [("assistant", "z"), ("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "c")]


def brute_top(rows, k=20):
    """(query, rank, row, score) by whole numbers; queries are ids divisible by 20, asked once by their smallest vector."""
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    first = {}
    for i, v in sorted(vectors, key=lambda r: (r[0], r[1])):
        if i % 20 == 0:
            first.setdefault(i, v)
    out = set()
    for i, v in first.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in vectors if j != i)[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


def test_search_over_blocks_ties_and_repeats(spark, monkeypatch):
    """Many blocks of both sides; equal vectors across blocks; ids and a query that repeat."""
    monkeypatch.setattr(search, "BLOCK", 50)
    monkeypatch.setattr(search, "EVERY", 20)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0, 1, 6), 1)]) for i in rng.permutation(400)]
    rows += [(401 + k, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5]) for k in range(60)]
    df = spark.createDataFrame([*rows, (7, rows[0][1])], "vec_id long, embedding array<double>")
    want = brute_top([*rows, (7, rows[0][1])])
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in search.search(df).collect()}
    assert {(q, n, s) for q, n, _, s in got} == {(q, n, s) for q, n, _, s in want} and got == want
    again = spark.createDataFrame([*rows, (40, [9.0] * 6)], "vec_id long, embedding array<double>")
    assert len({(r.query_id, r["rank"]) for r in search.search(again).collect()}) == search.search(again).count()


def test_search_of_large_components(spark):
    """Scores of up to 63 bits are exact; beyond, they count as the nearest long."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.integers(-33000, 33000, 8)]) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in search.search(df).collect()} == brute_top(rows)
    huge = [(k, [1e150 * (k + 1), 1.0]) for k in range(30)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in search.search(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect())
    assert [r[2] for r in got if r[0] == 0] == [k + 1 for k in range(20)] and {r[3] for r in got} == {2**63 - 1}


def test_search_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [2.0, 0.5]), (5, [1.0]), (None, [1.0, 1.0]), (20, [float("inf"), 1.0]), (40, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    assert {(r.query_id, r["rank"], r.vec_id) for r in search.search(df).collect()} == {(0, 1, 4), (0, 2, 40), (40, 1, 0), (40, 2, 4)}
    assert search.search(df.where("false")).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "personal_data", "packing"]
    kept = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        texts = [r.text for r in out.collect()]
        assert len(texts) <= kept
        if name == "near_duplicates":
            assert all(k == c for k, _, c in brute_components(texts, 5))
        if name == "personal_data":
            assert not any(plain_base(t) for t in texts)
        kept, docs = len(texts), spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == kept


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, clashing names and an empty table go through all stages."""
    import corpus_pipeline

    long = " ".join(f"word{k}" for k in range(90))
    rows = [(1, long, "en", "s", 9, 0), (1, long, "en", "s", 9, 0), (2, long + " more", None, None, None, None), (None, long, "en", "s", 1, 1), (3, None, None, None, None, None), (4, "", "en", "s", 0, 0), (5, "mail a.b@c.example.org " + long.replace("word", "term"), "en", "s", 9, 0)]
    df = spark.createDataFrame(rows, DOCS + ", _score int")
    spark.createDataFrame([(1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns and set(docs.dtypes) == set(df.dtypes)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    kept = {(r.doc_id, r.text) for r in docs.collect()}
    assert {k for k, _ in kept} == {1, None, 5} and any("[EMAIL]" in t for _, t in kept)
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 3
    empty = tmp_path / "empty"
    spark.read.parquet(str(tmp_path / "labels.parquet")).where("false").write.parquet(str(empty / "labels.parquet"))
    df.where("false").write.parquet(str(empty / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_paths_are_public():
    assert packing.default_path() == public_tokenizers.path("word_bpe_49k.json")
