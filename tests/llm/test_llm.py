"""Training-data operators against brute force, libraries and edge cases."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from formweave.llm import bpe, common, components, decontam, htmltext, linededup, ngramjoin, quality, sharding, tokencount, toxicity, warc
from formweave.llm.common import BATCH_ROWS, table, written
from formweave.llm.components import connected_components, merge_components

ODD = [None, "", " ", "  a", "a  b \n c", "a \n", "x " * 300, "\x1c a\x1cb  c", "é́  x y", "a" * 3000 + " " + "é" * 200, "it's  don't 'll", " \n\n", "<|endoftext|> hi<|startoftext|>", "日本語 テキスト 12 ½²", "\r\n a", "\u0085x", "👍🏽 ok  👍", " 's", "a b c d e f g h i j k l m n"]


def frame(spark, texts, extra="clash"):
    """Rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, extra, extra, extra) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, slot string, score string")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.VOCABULARY)), special_tokens={})


def check_bpe(rows, texts, enc):
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe(spark, sf, documents, tiktoken_encoding):
    check_bpe(bpe.op2_byte_bpe(spark, sf).collect(), dict(documents), tiktoken_encoding)
    check_bpe(bpe.digests(frame(spark, ODD), "doc_id", "text").collect(), ODD, tiktoken_encoding)


def test_bpe_round_trip(spark, tiktoken_encoding):
    encoded = bpe.encode(frame(spark, ODD), "doc_id", "text")
    assert all(r.ids == tiktoken_encoding.encode_ordinary(ODD[r.doc_id] or "") for r in encoded.collect())
    assert all(r.bytes == (ODD[r.doc_id] or "").encode() for r in bpe.decode(encoded, "doc_id", "ids").collect())


def test_shingling_holds_little(spark, monkeypatch):
    """Words are held for a bounded part of the texts at once, and written tables send short batches, with the same sets."""
    texts = [b"a b c d e", None, b"", b"x" * 300, b"q r s t q r s t", b"m n"] * 20
    whole, seen = ngramjoin.shingle_sets(texts), []
    work = ngramjoin._shingle_sets
    monkeypatch.setattr(ngramjoin, "WORK_BYTES", 100)
    monkeypatch.setattr(ngramjoin, "_shingle_sets", lambda t, k: seen.append(sum(len(x or b"") for x in t.to_pylist())) or work(t, k))
    assert all((a == b).all() for a, b in zip(ngramjoin.shingle_sets(texts), whole, strict=True)) and max(seen) == 300 and len(seen) >= 20

    own = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = spark.range(2 * BATCH_ROWS, numPartitions=1).mapInArrow(lambda batches: (b.from_pydict({"id": [len(b)]}) for b in batches), "id long")
    assert max(r.id for r in written(sizes, "sizes").collect()) == BATCH_ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == own


def test_bpe_encodes_a_word_once(documents, tiktoken_encoding, monkeypatch):
    """A word that comes in other pieces of a later slice is not encoded again, and long words share fewer queries."""
    import public_tokenizers as P
    import pyarrow as pa

    codec, asked = bpe.Codec(P.path(bpe.VOCABULARY), P.PATTERN), []
    query = codec._query
    monkeypatch.setattr(codec, "_query", lambda sql, lists: asked.append(lists) or query(sql, lists))

    def encoded(texts):
        n, ids, back = codec.texts(pa.array(texts, pa.string()))
        assert ids.to_pylist() == [",".join(map(str, tiktoken_encoding.encode_ordinary(t or ""))) for t in texts]
        assert [len(i.split(",")) if i else 0 for i in ids.to_pylist()] == n.tolist()
        assert back.to_pylist() == [(t or "").encode() for t in texts]

    encoded(["xqzjk wvvqx", None, " xqzjk", "a  b"])
    assert sum(map(len, asked)) == 3
    encoded(["o wvvqx, wvvqx.", " xqzjk!  xqzjk", "xqzjk-"])
    assert sum(map(len, asked)) == 3
    monkeypatch.setattr(bpe, "QUERY_SQUARES", 1000)
    asked.clear()
    encoded([" ".join("qx" * 10 + chr(97 + i) for i in range(20))])
    assert max(map(len, asked)) == 2 and sum(map(len, asked)) == 20
    for most in (0, 50, 1000):
        codec.words, codec.pieces = bpe.Memo(most), bpe.Memo(most)
        for k in range(0, 60, 20):
            encoded([t for _, t in documents[k : k + 20]] + ODD[:5])


def test_token_counts(spark, sf, documents):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path(tokencount.VOCABULARY))
    n = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    texts = dict(documents)
    assert all(r.n_tokens == n(texts[r.doc_id]) for r in tokencount.op6_token_counts(spark, sf).collect())
    for r in tokencount.count_tokens(frame(spark, ODD), "doc_id", "text").collect():
        assert (r.n_tokens, r.n_bytes) == (n(ODD[r.doc_id]), len((ODD[r.doc_id] or "").encode()))


def test_decontamination(spark, sf, documents):
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    want = decontam.brute_force(documents, items)
    got = {r.doc_id: tuple(r)[1:] for r in decontam.op3_decontamination(spark, sf).collect()}
    assert got == want and any(w[4] for w in want.values())
    kept = decontam.drop_contaminated(table(spark, sf, "documents"), "text", decontam.phrase_blocks(table(spark, sf, "benchmark"), "item_id", "text"))
    assert {r.doc_id for r in kept.collect()} == {d for d, w in want.items() if not w[4]}


def test_decontamination_in_blocks_and_edges(spark):
    docs = [(0, None), (1, ""), (2, "the cat sat"), (3, "A Cat SAT on it"), (4, "w " * 30)]
    items = [(1, "cat sat"), (2, None), (3, "..."), (4, "w w w"), (5, "sat on")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = decontam.brute_force(docs, items)
    for size in (1, 10**6):
        blocks = decontam.phrase_blocks(b, "item_id", "text", block_words=size)
        found = {r.doc_id: (r.n_words, sum(s.b - s.a for s in r.spans), len(r["items"])) for r in decontam.find_spans(d, "doc_id", "text", blocks).collect()}
        assert found == {k: w[:3] for k, w in want.items()}
        assert {r.doc_id for r in decontam.drop_contaminated(d, "text", blocks).collect()} == {k for k, w in want.items() if not w[4]}
    assert decontam.find_spans(d, "doc_id", "text", decontam.phrase_blocks(b.limit(0), "item_id", "text")).where("size(spans) > 0").count() == 0


def test_ngram_join(spark, sf, documents):
    want = ngramjoin.brute_force(documents)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.op4_ngram_join(spark, sf).collect()} == want
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A b"), (5, "a b c d e"), (6, "a b c"), (7, "a  b\tc\n"), (8, "a b c d e")]
    got = ngramjoin.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], "doc_id int, text string, n_shingles int"), "doc_id", "text")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == ngramjoin.brute_force(rows)
    assert ngramjoin.near_duplicates(spark.createDataFrame([], "doc_id int, text string"), "doc_id", "text").count() == 0


def near_copies(kind, copies=500, size=120):
    """A text of many words in copies that each differ from it in ways of their own."""
    pick, rows = random.Random(7), []
    for k in range(copies):
        ws = [f"w{j}" for j in range(size)]
        if kind == "words replaced":
            for j in range(pick.randrange(2, 10)):
                ws[pick.randrange(size)] = f"x{k}-{j}"
        elif kind == "words of a pool":
            for _ in range(pick.randrange(3, 9)):
                ws[pick.randrange(size)] = f"z{pick.randrange(6)}"
        elif kind == "words removed":
            for _ in range(pick.randrange(2, 10)):
                del ws[pick.randrange(len(ws))]
        elif kind == "ends cut":
            ws = ws[: pick.randrange(40, size)] + [f"q{pick.randrange(5)}" for _ in range(pick.randrange(12))]
        else:
            ws = [f"y{j}" if j * 53 % size < k // 5 else w for j, w in enumerate(ws)]
        rows.append((k, " ".join(ws)))
    return rows


@pytest.mark.parametrize("kind", ["words replaced", "words of a pool", "words removed", "ends cut", "chain"])
def test_ngram_join_of_a_group_of_near_copies(spark, kind):
    rows = near_copies(kind)
    want = ngramjoin.brute_force(rows)
    got = ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id", "text")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_least_matches_do_not_fall():
    for percent in (80, 85):
        found = [ngramjoin.least_matches(n, percent) for n in range(1, 3000)]
        assert found == sorted(found)


def test_shingle_sets():
    texts = [None, b"", b" \t", b"a", b" A b ", b"a b c d", b"\x0bA B\x0c c \xff\xfe d e f", b"x\x1cy z", "\u00a0a b c d \u00c9 e".encode(), b"a b c d a b c d a b c d"]
    sets = ngramjoin.shingle_sets(texts)
    assert [len(s) for s in sets] == [n for n, _ in (ngramjoin.brute_force(list(enumerate(t and t.decode("latin-1").replace("\xa0", "_").replace("\x1c", "_").replace("\x85", "_") for t in texts)))).values()]
    assert all((s[1:] > s[:-1]).all() for s in sets) and ngramjoin.shingle_sets([]) == []


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (5, 5), (2, 1), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}


def test_rounds_of_components_take_the_files_that_their_edges_need(spark, monkeypatch):
    files, forget = [], components.forget
    monkeypatch.setattr(components, "forget", lambda t: (files.append(len(t.inputFiles())), forget(t)))
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = {r.node: r.component for r in connected_components(spark.range(200).selectExpr("id AS a", "id + 1 AS b")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == dict.fromkeys(range(201), 0) and set(files) == {1}
    assert len(common.written(spark.range(0, 5 * common.FILE_ROWS, 1, 12), "many", rows=5 * common.FILE_ROWS).inputFiles()) == 5


def test_sifted_keeps_what_is_wanted(spark, monkeypatch):
    wanted = spark.createDataFrame([(-(2**63),), (-1,), (7,), (2**63 - 1,)], "k long")
    rows = spark.createDataFrame([(-(2**63), "a"), (-1, "b"), (7, "c"), (7, "c"), (8, "d"), (2**63 - 1, "e"), (None, "f")], "key long, x string")
    assert sorted(r.x for r in common.sifted(rows, "key", wanted.toDF("key")).collect()) == ["a", "b", "c", "c", "e"]
    monkeypatch.setattr(common, "FILTER_BITS", 8)
    assert {"a", "b", "c", "e"} <= {r.x for r in common.sifted(rows, "key", wanted.toDF("key")).collect()}


def test_quality_edges(spark):
    good = "Plain words of a line here.\n" * 1 + " ".join(f"word{k}" for k in range(60)) + "."
    junk = "\n".join(" | ".join(f"a{k}{j}" for k in range(20)) for j in range(6))
    rows = {r.doc_id: r for r in quality.judge(frame(spark, [None, "", good, junk, "same " * 80, good + "\n" + "Click here | now | or | then"]), "doc_id", "text").collect()}
    assert [rows[k].kept for k in range(6)] == [False, False, True, False, False, True]
    assert rows[4].n_repeat_words == 80 and rows[4].base_failed and rows[0].n_words == 0
    assert rows[5].cleaned == good
    cleaned = quality.clean(frame(spark, [good, junk]), "text")
    assert [(r.doc_id, r.n_tokens) for r in cleaned.collect()] == [(0, "clash")]


def test_line_dedup(spark, documents, sf):
    pattern = re.compile(linededup._STARTS)
    places, sets = defaultdict(list), {}
    for doc, text in documents:
        for pos, line in enumerate((text or "").split("\n")):
            line = line.strip(" ").lower()
            if len(line) >= linededup.MIN_CHARS:
                places[line].append((doc, pos))
                sets[line] = frozenset(pattern.findall(line))
    keys, parent = list(sets), {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = defaultdict(list)
    for i, k in enumerate(keys):
        for j, n in Counter(j for s in sets[k] for j in holders[s]).items():
            if n >= linededup.SIMILAR * (len(sets[k]) + len(sets[keys[j]]) - n):
                parent[root(k)] = root(keys[j])
        for s in sets[k]:
            holders[s].append(i)
    groups = defaultdict(list)
    for k in keys:
        groups[root(k)] += places[k]
    want = Counter(doc for g in groups.values() for doc, _ in sorted(g)[1:])
    got = {r.doc_id: r.n_removed for r in linededup.op8_line_dedup(spark, sf).collect()}
    assert sum(abs(got[d] - want[d]) for d in got) <= 0.01 * sum(want.values())


def test_line_dedup_edges(spark):
    line = "Some long line of text that is repeated in here, yes."
    rows = [(1, None), (2, ""), (None, "x" * 40), (3, "x" * 40), (4, f"short\n{line}\n{line}"), (4, f"short\n{line}\n{line}"), (5, f"short\n{line.upper()}")]
    out = linededup.dedup_lines(spark.createDataFrame([(*r, "e") for r in rows], "doc_id int, text string, gone string"), "doc_id", "text").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter([(1, None), (2, ""), (None, "x" * 40), (3, ""), (4, f"short\n{line}"), (4, f"short\n{line}"), (5, "short")])


def line_groups(lines, similar=linededup.SIMILAR, n=12):
    """Components of distinct lines by all pairs of shingle sets, which are cut here on their own."""
    sets = [{x[i : i + n] for i in range(max(1, len(x) - n + 1))} for x in lines]
    parent = list(range(len(lines)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and both >= similar * (len(x) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    return [root(k) for k in range(len(lines))]


def removed_lines(spark, lines):
    """Whether each line goes, when it is a document of its own."""
    out = linededup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string"), "doc_id", "text").collect()
    return [not r.text for r in sorted(out)]


def test_line_dedup_shingles_of_every_position(spark):
    lines = [
        "https://www.example.org/reports/2019/annual",
        "https://www.another-site.net/x/y/z/q/1234",
        "see https://www.a.org/first/of/the/pages/index",
        "see https://www.a.org/quite/another/place/list",
        "0123456789abcdef0123456789abcdef0123aaaa",
        "0123456789abffffeeeeddddccccbbbbaaaa9999",
        "สวัสดีครับวันนี้อากาศดีมากเราไปเที่ยวทะเลกัน",
        "สวัสดีครับวันนี้ฝนตกหนักต้องอยู่บ้านทั้งวันเลย",
        "x" * 20 + "👍🏽 of a line with signs beyond the first plane 👍",
        "x" * 20 + "👍🏽 of a line with signs beyond the first plane 👍!",
        "a line of plain words that go on for quite a while, until it ends, somewhere far to the right of here",
        "a line of plain words that go on for quite a while, until it ends, somewhere far to the right of her.",
    ]
    groups = line_groups(lines)
    assert len(set(groups)) == 10
    assert removed_lines(spark, lines) == [g in groups[:k] for k, g in enumerate(groups)]
    hashed = spark.createDataFrame([(x,) for x in lines], "line string").select("line", linededup._shingles("line").alias("s"), linededup._least("line").alias("m")).collect()
    for r in hashed:
        assert len(r.s) == len({r.line[i : i + 12] for i in range(len(r.line) - 11)}) == len(set(re.findall(linededup._STARTS, r.line)))
        assert r.m == sorted(r.s)[: linededup.BOTTOM]


def test_line_dedup_hashes_are_the_least_distinct_ones(spark):
    lines = ["short", "twelve chars", "=" * 90, "ab" * 70, "a line of some thirty characters", "\u4e2d\U00020000" * 30, " ".join(f"word{i}" for i in range(60))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_id long, line string")
    want = {r.line_id: sorted(set(r.h)) for r in df.select("line_id", linededup._hashes("line").alias("h")).collect()}
    parts = df.selectExpr("line_id", "explode(sequence(1, greatest(char_length(line) - 11, 1))) AS i", "line").selectExpr("line_id", "xxhash64(encode(substring(line, i, 12), 'UTF-32')) AS h")
    assert want == {r.line_id: sorted(r.h) for r in parts.groupBy("line_id").agg(F.collect_set("h").alias("h")).collect()}
    assert {r.line_id: [m for m in r[1:] if m is not None] for r in linededup._signatures(df).collect()} == {k: v[: linededup.BOTTOM] for k, v in want.items()}
    assert {r.line_id: r.sketch for r in df.select("line_id", linededup._least("line", linededup.SKETCH).alias("sketch")).collect()} == {k: v[: linededup.SKETCH] for k, v in want.items()}


def test_line_dedup_reads_few_lines_again(spark, monkeypatch):
    seen, sifted = [], linededup.sifted
    monkeypatch.setattr(linededup, "sifted", lambda *a: seen.append((out := written(sifted(*a), "sifted")).count()) or out)
    texts = [hashlib.sha256(b"%d" % i).hexdigest() for i in range(300)] + ["this line comes back with a few more words, changed a little " + x for x in ("here", "there")]
    lines = linededup._lines(spark.createDataFrame([(i, i, x) for i, x in enumerate(texts)], "id long, mark long, text string"))
    assert linededup.line_components(lines).count() == 2
    assert len(seen) == 1 and 2 <= seen[0] < 100


def test_line_dedup_shuffles_only_what_may_go(spark, monkeypatch):
    """Lines that come once and have no similar one don't meet the others, nor are texts shuffled that lose nothing."""
    seen = {}

    def kept(df, label, **more):
        out = written(df, label, **more)
        seen[label] = out.count()
        return out

    def sifted(df, key, wanted):
        out = common.sifted(df, key, wanted)
        seen[key] = out.count()
        return out

    monkeypatch.setattr(linededup, "written", kept)
    monkeypatch.setattr(linededup, "sifted", sifted)
    texts = [hashlib.sha256(b"%d" % i).hexdigest() for i in range(300)] + ["this line comes twice, word by word", "this line comes twice, word by word\nand another", None]
    rows = spark.createDataFrame([(i, x, i + 0.5) for i, x in enumerate(texts)], "doc_id int, text string, _bucket double")
    out = {r.doc_id: r for r in linededup.dedup_lines(rows, "doc_id", "text").collect()}
    assert [out[i].text for i in range(303)] == texts[:301] + ["and another", None] and all(out[i]._bucket == i + 0.5 for i in out)
    assert seen["occurrences"] == 2 and seen["gone"] == 1 and 1 <= seen["_fw_own"] < 10


def test_sifted_parts_rows(spark):
    rows = spark.createDataFrame([(-1, "a"), (7, "b"), (7, "c"), (8, "d"), (None, "e"), (2**62, "f")], "key long, x string")
    wanted = spark.createDataFrame([(7,), (7,), (2**62,)], "key long")
    assert sorted(r.x for r in common.sifted(rows, "key", wanted).collect()) == ["b", "c", "f"] == sorted(r.x for r in common.among(rows, "key", wanted).collect())
    assert sorted(r.x for r in common.sifted_out(rows, "key", wanted).collect()) == ["a", "d", "e"]
    assert common.sifted_out(rows, "key", wanted.limit(0)).count() == 6


def test_line_dedup_in_bands_of_a_template(spark):
    """Lines that share most of a template are not similar, but each has a twin: every twin is found."""
    own = ["".join(hashlib.sha256(f"{k} {j}".encode()).hexdigest() for j in range(2))[:100] for k in range(400)]
    template = " ".join(f"Word{j * j}" for j in range(30)).lower()
    lines = [f"{template} {x}" for x in own] + [f"{template} {x}." for x in own]
    assert line_groups(lines[:20] + lines[400:420])[:20] == line_groups(lines[:20] + lines[400:420])[20:]
    assert removed_lines(spark, lines) == [False] * 400 + [True] * 400


def test_line_dedup_of_groups_away_from_the_centre(spark):
    """Lines of one difference from the most common line are similar to each other, and not to that line."""
    pick = random.Random(5)
    base = " ".join(f"word{j * j}" for j in range(40))
    away = base[:150] + " ".join(f"other{j * j * j}" for j in range(14))
    rows = [(text, k) for text in (base, away) for k in range(200)]
    lines = list(dict.fromkeys(f"{text} {pick.randrange(10**6)}" + "." * (k % 3) for text, k in rows))
    groups = line_groups(lines)
    assert len(set(groups)) == 2
    assert removed_lines(spark, lines) == [g in groups[:k] for k, g in enumerate(groups)]


def test_line_dedup_of_loosely_similar_lines(spark, monkeypatch):
    """A family of lines that are half similar to its first is paired, not cut into differences; its pairs of twins are found."""
    seen, differences = [], linededup._differences
    monkeypatch.setattr(linededup, "_differences", lambda members, texts: seen.append(members.count()) or differences(members, texts))
    pick = random.Random(3)
    words = [f"word{j * j}" for j in range(60)]
    own = [[w if pick.random() > 0.1 else f"o{k}x{j}" for j, w in enumerate(words)] for k in range(14)]
    lines = [" ".join(words)] + [" ".join(x) for x in own] + [" ".join(x) + "!" for x in own]
    groups = line_groups(lines)
    assert len(set(groups)) > 8
    assert removed_lines(spark, lines) == [g in groups[:k] for k, g in enumerate(groups)]
    assert seen == [0]


def test_merged_components(spark):
    found = spark.createDataFrame([(1, 1), (2, 1), (7, 7), (8, 7), (20, 20), (21, 20)], "node long, component long")
    merged = merge_components(found, spark.createDataFrame([(2, 8), (8, 30), (40, 41), (1, 2)], "a long, b long"))
    groups = defaultdict(set)
    for r in merged.collect():
        groups[r.component].add(r.node)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 7, 8, 30], [20, 21], [40, 41]]
    assert sorted(map(tuple, merge_components(found, spark.createDataFrame([], "a long, b long")).collect())) == sorted(map(tuple, found.collect()))


def test_line_dedup_recall_against_all_pairs(spark, documents):
    """Of the lines that go by all pairs of whole shingle sets 95 of 100 go, and hardly another."""
    lines = sorted({line.strip(" ").lower() for _, text in documents for line in (text or "").split("\n")})
    lines = [x for x in lines if len(x) >= 20]
    edited = [x[: len(x) // 2] + "#" * (k % 3) + x[len(x) // 2 + k % 3 :] + "." * (k % 5) for k, x in enumerate(lines[::8]) if len(x) > 80]
    lines = list(dict.fromkeys(lines + edited))
    groups, gone = line_groups(lines), removed_lines(spark, lines)
    want = [g in groups[:k] for k, g in enumerate(groups)]
    found = sum(a and b for a, b in zip(want, gone, strict=True))
    assert sum(want) >= 50 and found >= 0.95 * sum(want) and found >= 0.98 * sum(gone)


def test_line_dedup_of_short_lines(spark):
    lines = ["subscribe to our newsletter now", "read more", "今日は天気がいいので散歩に行きます。", "谢谢你", "วันนี้", "}", "of.", "谢谢"]
    gone = removed_lines(spark, lines + lines + ["read mare", "今日は雨が強いので家で本を読みます。"])
    assert gone == [False] * 8 + [True] * 5 + [False] * 5


def test_empty_tables_and_repeated_rows(spark):
    """Row for row: no rows give none, and repeated ones stay as often as they came; extra columns may clash."""
    per_row = [
        lambda d: bpe.digests(d, "doc_id", "text"),
        lambda d: quality.judge(d, "doc_id", "text"),
        lambda d: toxicity.score(d, "doc_id", "text", toxicity.Model(share=0.25)),
        lambda d: linededup.dedup_lines(d, "doc_id", "text"),
        lambda d: tokencount.count_tokens(d, "doc_id", "text"),
        lambda d: htmltext.extract(d, "doc_id", "id", "text"),
    ]
    empty = spark.createDataFrame([], "doc_id long, text string, id string")
    twice = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "x"), (2, "", "x")], empty.schema)
    for work in per_row:
        assert work(empty).collect() == []
        assert Counter(r.doc_id for r in work(twice).collect()) == {1: 2, None: 1, 2: 1}
    assert quality.clean(empty, "text").collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(warc.plan_revisits(pages, "page_id", "url", "html")), "long").collect() == []


def test_warc(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c", None), (4, "u r l", ""), (5, "x", "é" * 500_000), (5, "x", "é" * 500_000), (None, "n", "same")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.read_archives(warc.write_archives(warc.plan_revisits(pages, "page_id", "url", "html")), "long").collect()
    assert Counter((r.id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == Counter([(1, "revisit", 2, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 1_000_000), (5, "response", None, 1_000_000), (None, "revisit", 2, 4)])
    good = warc.page_record(1, "u", b"abc", 3, warc.digest32(b"abc"), None, False)
    assert [r.payload for r in warc.read_records(io.BytesIO(good * 3))] == [b"abc"] * 3
    broken = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = zlib.decompress(good, 31).replace(b"abc", b"abd")
    for bad in (good[:-5], broken.compress(text) + broken.flush()):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))
    assert base64.b32encode(hashlib.sha1(b"").digest()).decode() == warc.digest32(b"")


def test_warc_broken_records_raise_value_errors():
    good = warc.page_record(7, "http://a", b"text", 4, warc.digest32(b"text"), None, False)
    assert [r.payload for r in warc.read_records(io.BytesIO(good + good))] == [b"text", b"text"]
    flipped = bytearray(good)
    flipped[len(good) // 2] ^= 0x55
    nameless = warc.member([("WARC-Type", "response"), ("Content-Length", "0")], b"")
    for broken in (bytes(flipped), b"no gzip at all", good[:-20], nameless):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(broken)))


def test_html(spark, sf):
    rows = htmltext.op9_html_text(spark, sf).collect()
    source = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    assert all(r.text and r.n_chars == len(r.text) and "track(" not in r.text and "©" not in r.text for r in rows) and len(rows) == len(source)
    page = "<body><nav><a href=/>Home</a></nav><div><h1>A &amp; b</h1><p>First <b>bold</b>\n text of the article.<p>Second one, a < b.</div><div class='comments'><p>I disagree with it all, said he.</p></div><footer>foot</footer>"
    assert htmltext.main_text(page) == "A & b\nFirst bold text of the article.\nSecond one, a < b."
    assert [htmltext.main_text(x) for x in (None, "", "<p>", "plain")] == ["", "", "", "plain"]


def test_html_wrappers_that_are_not_noise():
    article = "<p>The first paragraph of an article, with some words in it.</p><p>And then a second one that goes on.</p>"
    want = "The first paragraph of an article, with some words in it.\nAnd then a second one that goes on."
    kept = ["class='overflow-hidden'", 'style="overflow:hidden"', 'aria-hidden="false"', "data-hidden=x", "hidden='until-found'", "class='content with-sidebar'", "class=no-sidebar", "id='layout-with-sidebar'", "class='has-banner'", "class='widget'", "title='share role=menu'"]
    for attrs in kept:
        assert htmltext.main_text(f"<body><div {attrs}>{article}</div></body>") == want, attrs
        assert htmltext.main_text(f"<body><div {attrs}>{article}<div class='share'><p>Tell a friend</p></div></div></body>") == want, attrs
    other = "<p>Something else that stands beside it, in a longer text than that of the article which is on this page, and more.</p>"
    for attrs in ("hidden", "HIDDEN=''", "aria-hidden=true", 'style="color:red; display: none"', "role=menu", "hidden class='no-sidebar'"):
        assert htmltext.main_text(f"<body><div>{article}</div><div {attrs}>{other}</div></body>") == want, attrs
    assert htmltext.main_text(f"<body><div><svg viewBox='0 > 1'/>{article}</div></body>") == want
    assert htmltext.main_text(f"<body><div><svg><text>x</text></svg><math/>{article}</div></body>") == want


def test_sharding(spark, sf):
    names = sharding.shard_names()
    filled = sharding.fill_table(names)
    assert max(Counter(filled).values()) - min(Counter(filled).values()) <= 1
    for r in sharding.op10_sharding(spark, sf).collect():
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, names[filled[slot]])
    fewer = sharding.fill_table(names[:-1])
    assert sum(a != b for a, b in zip(filled, fewer, strict=True)) < 3 * sharding.SLOTS / len(names)
    assert sharding.fill_table(["a", "b"], 7).count(0) in (3, 4)
    with pytest.raises(ValueError):
        sharding.fill_table(names, 65536)
    assert {r.text for r in sharding.assign_shards(frame(spark, [None, "a", "a"]), "text").collect()} == {None, "a"}


def test_toxicity(spark):
    mild = [f"the day was {a} and the {b} went on with it" for a in ("long", "warm", "dull", "fair") for b in ("river", "road", "story", "meeting", "garden", "train", "house", "school", "market", "winter")]
    harsh = [m.replace("went", "you worthless idiot went") for m in mild]
    rows = [(t.encode(), y) for pair in zip(mild, harsh, strict=True) for y, t in enumerate(pair)]
    model = toxicity.fit(rows, 0.5)
    scores = model.score([b"what a worthless idiot he was again", b"what a warm garden it was again", b""])
    assert scores[0] > scores[1] and all(0 <= s <= 1 for s in scores)
    assert toxicity.fit([], 0.0).score([b"x"]) == [0.0]
    out = toxicity.score(frame(spark, [None, "", "a" * 100_000]), "doc_id", "text", model).collect()
    assert len(out) == 3 and all(0 <= r.score <= 1 for r in out)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.where("n_chars <> length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, last.collect()))


def test_pipeline_near_duplicates_of_80_percent(spark, sf):
    import corpus_pipeline

    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words + [f"x{k}" for k in range(22)])), (3, " ".join(words + [f"y{k}" for k in range(40)]))]
    kept = corpus_pipeline.ngram_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
