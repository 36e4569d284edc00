import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, media, packing, quality, resharding, sentencepiece_viterbi as sv, topk, url_filter
from millrace.llm.queries import URL_RULES

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "Hello  world", "line\n\nnext line \n", "été ñandú 日本 😀", "x" * 5000, "the cat sat. " * 900, "<|endoftext|> is text", "tab\tand  two", "a b c"]


def docs(spark, texts=TEXTS, extra=False):
    rows = [(i, t) for i, t in enumerate([*texts, *texts[3:6]])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("shard", F.lit("clash")).withColumn("ids", F.lit(1)) if extra else df


# url filter


def test_hosts_and_rules(spark):
    urls = [
        ("https://a.EXAMPLE.com/en/7?x", "a.example.com", "/en/7", "example.com/en/7", "allow"), ("http://example.com/en/8#t", "example.com", "/en/8", "com/en/", "block"),
        ("http://notexample.com/en/70", "notexample.com", "/en/70", "com/en/", "block"), ("ftp://x.net/de/", "x.net", "/de/", "net/de/", "allow"), ("http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        ("http://example.org/en/", "example.org", "/en/", None, "allow"), ("no scheme.com/en/", "", "", None, "allow"), (None, "", "", None, "allow"), ("x://", "", "", None, "allow"), ("http://com/en/?q=http://b.net/de/", "com", "/en/", "com/en/", "block"),
        ("http://ÄA.com", "ÄA.com".replace("A.", "a."), "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, block boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, none, URL_RULES).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}


def test_long_urls_repeated_give_few_rules(spark):
    long = "https://h.example/" + "/".join(f"{a}{b}" for a in "abcdef" for b in "vwxyz")
    other = [f"https://h.example/{w}/" + "/".join(f"{a}{w}{i}" for i, a in zip("klmnopqrstuvwxyz"[:16], "abcdefghijklmnop")) for w in ("one", "two")]
    rows = [(long, True)] * 10 + [(u, False) for u in other for _ in range(20)] + [("https://x.org/", False)] * 10
    pages = spark.createDataFrame([(1, long), (2, other[0]), (3, "https://x.org/")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.mined_rule is not None) for r in url_filter.filter_urls(pages, spark.createDataFrame(rows, "url string, block boolean")).collect()}
    assert got == {1: ("block", True), 2: ("allow", False), 3: ("allow", False)}


def test_mined_rules_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        host, word = rnd.choice(["shop", "news", "blog"]), rnd.choice(["buy", "read", "cheap"])
        block = (host == "shop" and word == "cheap") if rnd.random() < 0.95 else rnd.random() < 0.5
        rows.append((i, f"http://{host}.site/{word}/{i}?ref={i}", block))
    df = spark.createDataFrame(rows, "page_id long, url string, block boolean")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df.drop("block"), df.select("url", "block")).collect()}
    want = {}
    support = defaultdict(lambda: [0, 0])
    sets = {}
    from itertools import combinations

    for i, url, block in rows:
        host, word = url.split("/")[2], url.split("/")[3]
        tokens = sorted({*(f"h:{x}" for x in host.split(".")), f"p:{word}", "p:0", "q:ref"})
        sets[i] = tokens
        for n in range(1, len(tokens) + 1):
            for c in combinations(tokens, n):
                support[c][0] += 1
                support[c][1] += block
    least = max(0.005, 5 / len(rows)) * len(rows)
    rules = [c for c, (n, b) in support.items() if b >= least and b / n >= 0.8]
    for i, tokens in sets.items():
        want[i] = "block" if any(set(c) <= set(tokens) for c in rules) else "allow"
    assert got == want and "block" in want.values()


def test_rules_of_long_urls_are_all_mined(spark):
    rnd = random.Random(8)
    noise = [f"n{c}" for c in "abcdefghijklm"]
    mixed = [(["wa", "wb", *noise], True)] * 60 + [([rnd.choice(["wa", "wb"]), *rnd.sample(noise, 2)], False) for _ in range(180)]
    alike = [(["ya", "yb"], True)] * 20
    rows = [(f"http://h.x/{'/'.join(w)}", b) for w, b in mixed + alike]
    # the pair that decides says less by single tokens than the noise; each of two tokens of the same URLs decides
    pages = ["http://z/wa/wb", "http://z/wa", "http://z/wb", "http://z/na", "http://z/ya", "http://z/yb", "http://z/na/nb/nc/nd/ne"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df, spark.createDataFrame(rows, "url string, block boolean")).collect()}
    assert [got[i] for i in range(len(pages))] == ["block", "allow", "allow", "allow", "block", "block", "block"]


def test_url_empty_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, block boolean")
    assert url_filter.filter_urls(empty.drop("block"), empty.select("url", "block"), URL_RULES).count() == 0


# packing


def test_tokenizer_equals_library():
    t = packing.WordCachedTokenizer(VOCAB)
    texts = [x or "" for x in TEXTS] + ["​​a", "a ᠎b", " lead", "trail ", "don't we'll I've", "1,234.5 %%% x"]
    assert t.encode(texts) == [np.asarray(e.ids, "<u4").tobytes() for e in t.tok.encode_batch(texts, add_special_tokens=False)]
    assert t.encode(texts) == t.encode(texts)


def test_added_tokens_have_the_ids_of_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    fresh, texts = Tokenizer.from_file(VOCAB), ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "a  b <|endoftext|>", "<|endoftext|", *(x or "" for x in TEXTS)]
    assert fresh.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    assert packing.WordCachedTokenizer(VOCAB).encode(texts) == [np.asarray(fresh.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_packing(spark):
    df = docs(spark, extra=True)
    rows = packing.pack(df, VOCAB, seq_len=64, open_bins=4, keep_ids=True).collect()
    t = packing.WordCachedTokenizer(VOCAB)
    want = {r.doc_id: t.encode([r.text or ""])[0] + b"\0\0\0\0" for r in df.collect()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for d, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in own) == want[d] and [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == 64 for r in own[1:])
    assert by_doc.keys() == want.keys()
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack(df.limit(0), VOCAB).count() == 0


def test_best_fit_equals_a_plain_one():
    rnd = random.Random(1)
    fit, plain, closed = packing.BestFit(50, 6), {}, 0
    for _ in range(3000):
        n = rnd.randrange(1, 51)
        name, offset = fit.place(n)
        fits = [f for f in plain.values() if f >= n]
        if fits:
            assert plain[name] == min(fits) and offset == 50 - min(fits)
            free = plain.pop(name) - n
        else:
            assert name not in plain and offset == 0
            free = 50 - n
        if free:
            if len(plain) == 6:
                least = min(plain.values())
                if least >= free:
                    continue
                open_now = {b for own in fit.by_free for b in own}
                gone = [b for b in plain if b not in open_now]
                assert [plain[b] for b in gone] == [least]
                plain.pop(gone[0])
            plain[name] = free


# resharding


def test_reshard(spark):
    rnd = random.Random(2)
    rows = [(i, None if i % 50 == 0 else "x" * rnd.randrange(0, 200)) for i in range(500)] + [(3, "same")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit(1)).repartition(3).persist()
    old = F.pmod(F.col("doc_id"), F.lit(4))
    uri, transfers = resharding.reshard(df, old, 6)
    got = resharding.read_shards(spark, uri, df.schema, [F.col("doc_id"), F.col("text")]).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((d, t or "") for d, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[j]) for j in range(6)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    # the fewest bytes: every old shard sends its smallest surplus rows
    kept = sum(len((r.text or "").encode()) + 8 for r in got if r.shard == r.doc_id % 4)
    best = 0
    for j in range(4):
        own = sorted((len((t or "").encode()) + 8 for d, t in rows if d % 4 == j), reverse=True)
        best += sum(own[: len(by[j])])
    assert kept >= 0.98 * best


def test_reshard_empty(spark):
    uri, transfers = resharding.reshard(spark.createDataFrame([], "doc_id long, text string"), F.lit(0), 3)
    assert transfers == []


def test_flow_is_cheapest():
    rnd = random.Random(5)
    for _ in range(20):
        blocks = [(i % 3, (i // 3) * 10, rnd.randrange(0, 9), rnd.randrange(1, 90)) for i in range(6)]
        out = resharding.plan_transfers(blocks, 4)
        total = sum(b[2] for b in blocks)
        into = [sum(t[2] for t in out if t[3] == j) for j in range(4)]
        assert sum(into) == total and max(into) - min(into) <= 1


@pytest.mark.parametrize("new_shards", [2, 3, 5])
def test_flow_moves_the_fewest_bytes(new_shards):
    """A shard over its capacity has to give away its rows of least bytes, a shard that ends all of them; nothing else moves."""
    rnd = random.Random(new_shards)
    for _ in range(30):
        blocks = [(i % 3, (i // 3) * 10, rnd.randrange(1, 9), rnd.randrange(1, 90)) for i in range(9)]
        out = resharding.plan_transfers(blocks, new_shards)
        per_row = {(old, first): size / rows for old, first, rows, size in blocks}
        block_of = lambda old, first: max(f for o, f, *_ in blocks if o == old and f <= first)
        moved = sum(rows * per_row[old, block_of(old, first)] for old, first, rows, new in out if new != old)
        into = [sum(t[2] for t in out if t[3] == j) for j in range(new_shards)]
        best = 0.0
        for old in range(3):
            each = sorted(c for (o, _, rows, size) in blocks if o == old for c in [size / rows] * rows)
            best += sum(each[: max(0, len(each) - into[old])] if old < new_shards else each)
        assert moved == pytest.approx(best)


# media


def test_media(spark):
    rows = media.media_columns(spark, docs(spark, extra=True)).collect()
    texts = {r.doc_id: r.text for r in docs(spark).collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32, r.height) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) // 64)
    assert media.media_columns(spark, docs(spark).limit(0)).count() == 0


# top-k


@pytest.mark.parametrize("dim", [3, 16])
def test_topk_equals_brute_force(spark, dim):
    rnd = np.random.default_rng(dim)
    x = rnd.normal(size=(300, dim)).astype("f4")
    x[100:140] = x[0]
    rows = [(i, None if i == 7 else [float(v) if i != 9 else float("nan") for v in r]) for i, r in enumerate(x)]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0, 5, groups=3).collect()}
    v, ids = np.floor(256 * x.astype("f8")), np.array([i for i in range(300) if i not in (7, 9)])
    want = {}
    for i in range(0, 300, 10):
        s = v[ids] @ v[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:5]
        want |= {(i, k + 1): (int(ids[j]), int(s[j])) for k, j in enumerate(order)}
    assert got == want


def test_bounded_search_prunes_and_stays_exact():
    rnd = np.random.default_rng(0)
    x = np.floor(256 * rnd.normal(size=(1000, 4)))
    lists = topk.SortedLists(np.arange(1000), x)
    q = np.floor(256 * rnd.normal(size=(5, 4)))
    for (ids, scores), own in zip(lists.best(np.full(5, -1), q, 3, np.full(5, -np.inf)), q, strict=True):
        assert sorted(scores)[-3:] == sorted(x @ own)[-3:]


def test_topk_prunes_and_counts_what_it_reads():
    rnd = np.random.default_rng(1)
    x = np.floor(256 * rnd.normal(size=(4096, 3)))
    lists = topk.SortedLists(np.arange(4096), x)
    q = np.floor(256 * rnd.normal(size=(50, 3)))
    found = lists.best(np.full(50, -1), q, 5, np.full(50, -np.inf))
    assert all(sorted(s)[-5:] == sorted(x @ own)[-5:] for (_, s), own in zip(found, q, strict=True))
    assert lists.resolved < 0.1 * 50 * 4096 and lists.read < 0.7 * 50 * 4096 * 3


def test_topk_defined_cases(spark):
    shape = "vec_id long, embedding array<double>, score string, rank string, grp string"
    run = lambda rows: [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, shape), F.col("vec_id") % 10 == 0, 5, groups=3).orderBy("query_id", "rank").collect()]
    row = lambda i, *v: (i, list(v), "x", "y", "z")
    assert run([]) == []
    assert run([row(0, 1.0, 2.0)]) == []
    assert run([row(0, 1.0, 2.0), row(1, 1.0, 0.0), row(2, 1.0, 0.0), row(3, None, 1.0), (4, None, "x", "y", "z"), row(5, 1.0)]) == [(0, 1, 1, 65536), (0, 2, 2, 65536)]
    assert run([row(0, 1.0), row(0, 1.0), row(3, 2.0), row(3, 2.0)]) == [(0, i, 3, 131072) for i in (1, 2, 3, 4)]
    huge = run([row(0, 1e30, 1.0), row(1, 1e30, 0.0), row(2, 1e29, 0.0), row(3, 0.0, 5.0), row(4, -1e30, 0.0)])
    assert huge == [(0, 1, 1, (1 << 63) - 1), (0, 2, 2, (1 << 63) - 1), (0, 3, 3, 256 * 1280), (0, 4, 4, -(1 << 63))]
    number = 256 * (3 * 10**8 + 1) * 256 * 300000  # above 2**53
    assert run([row(0, 3e8 + 1, 1.0), row(1, 3e5, 1.0), row(2, 3e5, 2.0)]) == [(0, 1, 2, number + 2 * 65536), (0, 2, 1, number + 65536)]


# sentencepiece


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:  # the library's single precision can't tell totals of this size apart
        p.score = max(p.score, -40000)
    path = tmp_path_factory.mktemp("sp") / "u.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_viterbi_equals_library(unigram):
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=unigram), sv.UnigramModel(unigram)
    for t in [*(x for x in TEXTS if x and len(x) < 1000), "The quick brown fox", "  two  spaces ", "naïve café", "0xDEADBEEF == 42"]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == sp.encode(t), t


def test_viterbi_is_optimal_and_streams(unigram):
    own = sv.UnigramModel(unigram)
    rnd = random.Random(4)
    for _ in range(60):
        s = "".join(rnd.choice("theand▁os日") for _ in range(rnd.randrange(1, 14)))
        best = {0: 0.0}
        for i in range(1, len(s) + 1):
            best[i] = max([best[j] + own.pieces[s[j:i]][1] for j in range(max(0, i - own.longest), i) if s[j:i] in own.pieces] + ([best[i - 1] + own.unk_score] if s[i - 1] not in own.pieces else []))
        score = {i: v for i, v in own.pieces.values()}
        ids, total, unknown = list(own.viterbi(s)), 0.0, sum(c not in own.pieces for c in s)
        total = sum(score.get(i, 0.0) for i in ids) + unknown * own.unk_score
        assert total == pytest.approx(best[len(s)])
    ids = own.viterbi("the" * 1000)
    assert next(ids) is not None  # committed before the end


def test_sentencepiece_round_trip(spark):
    rows = sv.encode_digests(docs(spark, extra=True).drop("ids"), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(TEXTS) + 3 and all(r.round_trip for r in rows)


# chat


def test_escapes_and_parse():
    rnd = random.Random(0)
    for _ in range(500):
        role, text = ("".join(rnd.choice("#\\< />:turn\nA") for _ in range(rnd.randrange(0, 20))) for _ in range(2))
        formatted, lo, hi = chat.format_turn(role, chat.escape(text))
        assert [x[:2] for x in chat.parse(formatted * 2)] == [(role, text)] * 2
        assert chat.unescape(formatted[lo:hi]) == text


def test_chat(spark):
    tricky = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", tricky), (1, 0, "user", None), (1, 1, "assistant", tricky), (None, 0, "user", "x"), (2, None, None, "a"), (2, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 * len(tricky)
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n\nassistant\n{tricky}\nassistant\n{tricky}\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256((tricky * 2).encode()).hexdigest()
    assert got[None].n_turns == 1 and got[2].loss_chars == 0
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


def test_query_sends_texts_through_the_visitor(spark, tmp_path, monkeypatch):
    from millrace.llm import queries

    seen, plain = [], chat.format_turns
    monkeypatch.setattr(chat, "format_turns", lambda turns: seen.append(turns) or plain(turns))
    spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "a <b")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op10_chat_format(spark, str(tmp_path)).collect()}
    assert {r.conv_id: [[(p.type, p.text) for p in r.parts]] for r in seen[0].filter("turn = 1").collect()}[1] == [[("text", "a <b")]]
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\na <b\n").hexdigest() and got[1].loss_chars == 4 and got[-7].n_turns == 2


def test_typed_parts(spark):
    df = spark.sql(f"select 1L conv_id, 0L turn, 'user' role, from_json('[{{\"type\":\"text\",\"text\":\"see <\"}},{{\"type\":\"image\",\"ref\":\"a.png\",\"width\":28,\"height\":15}},{{\"type\":\"audio\",\"ref\":\"b.wav\",\"seconds\":1.5}},{{\"type\":\"document\",\"ref\":\"c.pdf\",\"pages\":2}}]', 'array<{chat.PART}>') parts")
    r = chat.format_turns(df).first()
    assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 512)]
    assert next(chat.parse(r.formatted))[1] == "see <<|image:0|><|audio:1|><|document:2|>" and r.attachment_tokens == 554


def test_texts_that_look_like_placeholders_are_told_apart():
    fake = "<|image:0|>"
    body, attached = chat.flatten([{"type": "text", "text": fake}, {"type": "image", "ref": "a"}, {"type": "text", "text": fake + "\\\\"}, {"type": "vi deo|>", "ref": "b"}, {"text": None}])
    formatted, lo, hi = chat.format_turn("user", body)
    assert chat.parts_of(formatted[lo:hi]) == [("text", fake), ("image", 0), ("text", fake + "\\\\"), ("vi_deo__", 1)]
    assert [a["ref"] for a in attached] == ["a", "b"] and len(list(chat.parse(formatted * 2))) == 2


# quality


def test_quality_on_held_out_labels(spark):
    rnd = random.Random(0)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        text = [rnd.choice(words) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            text[::4] = ["junk%%%"] * 15
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, not bad))
    rows += [(5000, None), (5001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("log_weight", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, good boolean")
    kept = {r.doc_id for r in quality.selected_ids(df, lab).collect()}
    held_out = [i for i in range(1200) if not i % 3]
    assert sum((i in kept) == bool(i % 5) for i in held_out) > 0.97 * len(held_out)
    assert {5000, 5001} <= kept
    out = quality.selected_documents(df, lab)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == kept


def test_quality_without_labels_and_empty(spark):
    lab = spark.createDataFrame([], "doc_id long, good boolean")
    assert quality.selected_ids(docs(spark), lab).count() == len(TEXTS) + 3
    assert quality.selected_ids(docs(spark).limit(0), lab).count() == 0


def test_kth_greatest(spark):
    rnd = random.Random(8)
    values = [rnd.choice([rnd.random(), 0.5, 3.0]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 700, 1500, 2000):
        assert quality.kth_greatest(df, "v", k, most=50, bins=8) == sorted(values, reverse=True)[k - 1]


def test_quality_equals_brute_force(spark):
    """Weights, keys, k and the draw against loops over plain sets of n-grams; repeated rows and ties among them."""
    import math
    import re

    rnd = random.Random(21)
    rows = [(i, " ".join(rnd.choice(["bad", "awful"] if i % 4 == 0 and rnd.random() < 0.3 else ["good", "fine", "day", "sun", "sea"]) for _ in range(rnd.randrange(1, 30)))) for i in range(400)]
    rows += [(7, rows[7][1]), (400, "no no no no"), (401, None), (402, "")]
    labels = {i: i % 4 != 0 for i in range(0, 400, 3)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(list(labels.items()) + [(9, None), (9999, True)], "doc_id long, good boolean")

    def grams(text):
        words = re.findall(r"\w+|[^\w\s]+", text.lower())
        run = best = 1
        for a, b in zip(words, words[1:]):
            run = run + 1 if a == b else 1
            best = max(best, run)
        return {("word", w) for w in words} | {("run", min(best, quality.RUNS))}

    texts = [(d, grams(t)) for d, t in rows if t]
    n, target = len(texts), sum(labels.get(d) is True for d, _ in texts)
    raw, good = defaultdict(int), defaultdict(int)
    for d, own in texts:
        for g in own:
            raw[g] += 1
            good[g] += labels.get(d) is True
    share = target / n

    def ratio(g):
        expected = raw[g] * share
        z = (good[g] - expected) / math.sqrt(max(expected * (1 - share), 1e-9))
        r = math.log((good[g] + quality.PRIOR) / (expected + quality.PRIOR))
        return r if abs(z) >= quality.MIN_Z and abs(r) >= quality.MIN_RATIO else 0.0

    def noise(i, mask=(1 << 64) - 1):
        z = (i + 0x9E3779B97F4A7C15) & mask
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
        z ^= z >> 31
        return -math.log(-math.log(((z >> 11) + 0.5) / 2.0**53))

    weight = {(d, t): sum(map(ratio, grams(t))) if t else 0.0 for d, t in rows}
    scored = [(weight[r], weight[r] + noise(r[0]), r[0]) for r in rows]
    sample = [(weight[r], labels[r[0]]) for r in rows if r[0] in labels]
    goods = sum(g for _, g in sample)
    cuts = sorted({w for w, _ in sample if w <= 0}, reverse=True)
    gain = lambda w: sum(g for x, g in sample if x >= w) / goods - sum(not g for x, g in sample if x >= w) / (len(sample) - goods)
    best = max(cuts, key=gain)
    below = [w for w, _ in sample if w < best]
    at = (best + max(below)) / 2 if below else best
    k = sum(w >= at for w, _, _ in scored)
    least = sorted((key for _, key, _ in scored), reverse=True)[k - 1]
    want = sorted((d, round(w, 4), round(key, 4)) for w, key, d in scored if key >= least)
    got = sorted((r.doc_id, round(r.log_weight, 4), round(r.sample_key, 4)) for r in quality.selected_ids(df, lab).collect())
    assert [x[0] for x in got] == [x[0] for x in want] and 300 < len(want) < len(rows)
    assert all(abs(a[1] - b[1]) < 2e-3 and abs(a[2] - b[2]) < 2e-3 for a, b in zip(got, want, strict=True))
