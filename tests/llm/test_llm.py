"""Training-data operators on small cases, against brute force, libraries and held-out cases."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import abuse, bpe, labels, mixing, mojibake, sequences, splits
from tests.conftest import DATA, rows

tokenizers = pytest.importorskip("tokenizers")
ODD = ["", " ", "  x  ", "a\x1cb \x85 c　 d \t\n e", "<|endoftext|> hi", "𝔄'll x" * 50, "aaaaaaaa" * 400, "naïve Übergabe — « douteux »", "\x00\x01", "ab" * 50_000, "don't WE'RE it's 'sd"]


# 8


def test_encoding_equals_the_library(spark):
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path(name="byte_bpe_50k.json"))
    t.encode_special_tokens = True
    e = bpe.encoder(bpe.vocabulary_path())
    docs = [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").where("text IS NOT NULL").collect()]
    for text in [*ODD, *docs]:
        assert e.encode(text) == t.encode(text, add_special_tokens=False).ids
        assert e.decode(e.encode(text)) == text


def test_encoding_columns(spark):
    df = spark.createDataFrame([(1, "ab cd", 3), (2, None, 4), (3, "", 5), (3, "ab cd", 6)], "doc_id long, text string, ids int")
    got = rows(bpe.encode_column(df, "doc_id", "text"))
    assert got == [(1, got[0][1]), (2, []), (3, got[0][1]), (3, [])] and got[0][1]
    assert bpe.encode_column(df.where("false"), "doc_id", "text").count() == 0
    back = bpe.decode_column(bpe.encode_column(df, "doc_id", "text"), "doc_id", "ids")
    assert rows(back)[0] == (1, "ab cd")
    assert [r["n_tokens"] for r in bpe.count_tokens(df, ["doc_id"], "text").orderBy("doc_id", "n_tokens").collect()] == [2, 0, 0, 2]


def test_merging_against_the_plain_loop():
    ranks = bpe.encoder(bpe.vocabulary_path()).ranks

    def plain(b):
        parts = [b[i : i + 1] for i in range(len(b))]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rnd = random.Random(1)
    for _ in range(300):
        word = bytes(rnd.choice(b" abcdeilnorstxz\xc3\xa9") for _ in range(rnd.randint(1, 30)))
        assert bpe.merge(word, ranks) == plain(word)


# 4


def brute(seqs, n, share, least, lo, hi):
    count = Counter()
    for s in seqs:
        found = {()}
        for c in s:
            found |= {f + (c,) for f in found if len(f) < hi}
        count.update(f for f in found if len(f) >= lo)
    return {(">".join(p), k) for p, k in count.items() if k >= least and k >= n * share}


def flows(spark, data):
    return spark.createDataFrame(data, "record_id long, capture_id int, session_id string, timestamp timestamp_ntz, token string, g string, support int")


def test_patterns_against_brute_force(spark):
    from datetime import datetime, timedelta

    rnd = random.Random(3)
    data, by, i = [], {0: {}, 1: {}}, 0
    for cap in (0, 1):
        for s in range(30):
            toks, t = [rnd.choice(["A", "B", "C", None]) for _ in range(rnd.randint(1, 14))], datetime(2024, 1, 1)
            by[cap][s] = [x for x in toks if x]
            for x in toks:
                t += timedelta(minutes=rnd.choice([1, 40, 70]))
                for _ in range(rnd.choice([1, 1, 2])):  # sent again
                    data.append((i, cap, rnd.choice([f"S{s}", f" s{s}\t"]) if False else f"S{s}", t, x, "x", 1))
                    i += 1
    rnd.shuffle(data)
    got = rows(sequences.frequent_patterns(flows(spark, data), "capture_id", "session_id", "timestamp", "token", "record_id", 0.3, 5, 2, 4))
    want = sorted(((cap, p, k) for cap in (0, 1) for p, k in brute(by[cap].values(), 30, 0.3, 5, 2, 4)), key=str)
    assert got == want and got
    spread = sequences.frequent_patterns(flows(spark, data), "capture_id", "session_id", "timestamp", "token", "record_id", 0.3, 5, 2, 4, tree_patterns=0)
    assert rows(spread) == want


def test_pattern_edges(spark):
    from datetime import datetime as d

    t = d(2024, 1, 1)
    none = flows(spark, [(1, 0, "s", t, "A", "", 0)]).where("false")
    args = ("capture_id", "session_id", "timestamp", "token", "record_id")
    assert sequences.frequent_patterns(none, *args, 0.1, 1, 1, 3).count() == 0
    ties = flows(spark, [(2, 0, "s", t, "B", "", 0), (1, 0, " S ", t, "A", "", 0), (3, 0, None, t, "A", "", 0), (4, None, "s", t, "A", "", 0), (5, 0, "z", t, None, "", 0)])
    assert rows(sequences.frequent_patterns(ties, *args, 0.5, 1, 2, 2)) == [(0, "A>B", 1)]
    many = flows(spark, [(i, 0, f"s{i % 2}", t, f"T{i // 2}", "", 0) for i in range(80)])
    got = sequences.frequent_patterns(many, *args, 0.6, 1, 2, 2)
    assert rows(got.groupBy("support").count()) == [(2, 40 * 39 // 2)]
    assert [sequences.number(sequences.symbol(i)) for i in (0, 25, 55_000, 60_000)] == [0, 25, 55_000, 60_000]


def test_reduction_keeps_subsequences():
    rnd = random.Random(2)
    for _ in range(200):
        k, w = rnd.choice([2, 3, 4]), "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 25)))
        subs = lambda x: {"".join(c) for n in range(k + 1) for c in itertools.combinations(x, n)}  # noqa: B023, E731
        assert subs(w) == subs(sequences.reduce_steps(w, k))
    assert len(sequences.reduce_steps("abcde" * 4000, 5)) < 200


# 6


def store(spark, tmp_path, keys, name="store"):
    return splits.ComponentStore(spark, f"file://{tmp_path}/{name}", keys)


def test_splits(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i % 400}", None if i % 7 else "Monday") for i in range(4000)] + [(9001, " S1 ", "Friday"), (9002, None, "Friday")], "record_id long, session_id string, day string")
    one = store(spark, tmp_path, ["session_id"])
    one.update(df, "day")
    table = one.table()
    assert table.count() == 400 and table.select("entity", "split").distinct().count() == 400
    share = {r["split"]: r["n"] / 4001 for r in table.groupBy("split").agg(F.sum("n_records").alias("n")).collect()}
    assert all(abs(share[k] - v) < 0.01 for k, v in splits.SHARES)
    assert rows(one.torn().select("entity")) == ([("s1",)] if table.where("entity = '0:s1'").first()["days"] == ["Friday", "Monday"] else [])
    tagged = one.assign(df.withColumn("split", F.lit("x")))
    assert tagged.where("session_id IS NULL").first()["split"] is None and tagged.count() == df.count()
    was = {r["entity"]: r["split"] for r in table.collect()}
    one.update(df.select("record_id", F.concat(F.lit("n"), "session_id").alias("session_id"), "day"), "day")
    again = store(spark, tmp_path, ["session_id"])  # read from its folder
    now = {r["entity"]: r["split"] for r in again.table().collect()}
    assert len(now) == 801 and all(now[k] == v for k, v in was.items())
    none = store(spark, tmp_path, ["session_id"], "none")
    none.update(df.where("false"), "day")
    assert none.table().count() == 0 and none.torn().count() == 0


def test_components(spark):
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z", "y")] + [("hub", f"m{i}") for i in range(40)], "a string, b string")
    got = {r["v"]: r["root"] for r in splits.connect(chain).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and got["z"] == "y" and {got[f"m{i}"] for i in range(40)} == {"hub"}
    rnd = random.Random(6)
    edges = [(f"v{rnd.randint(0, 90)}", f"v{rnd.randint(0, 90)}") for _ in range(70)]
    got = {r["v"]: r["root"] for r in splits.connect(spark.createDataFrame(edges, "a string, b string")).collect()}
    want = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want and splits.connect(chain.where("false")).count() == 0


def test_quarantine_keeps_released_components(spark, tmp_path):
    made = store(spark, tmp_path, ["p", "q"])
    schema = "p string, q string, d string"
    made.update(spark.createDataFrame([(f"p{i}", f"q{i}", "x") for i in range(60)], schema), "d")
    named = {r["entity"]: r["split"] for r in made.table().collect()}
    a = next(i for i in range(60) if named[f"0:p{i}"] == "train")
    b = next(i for i in range(60) if named[f"0:p{i}"] == "test")
    c, d = [i for i in range(60) if named[f"0:p{i}"] == "train"][1:3]
    batch = spark.createDataFrame([(f"p{a}", f"q{b}", "y"), (f"p{a}", "new", "y"), ("p900", f"q{b}", "y"), (f"p{c}", f"q{d}", "y"), (f"p{c}", "follows", "y"), (None, None, "y")], schema)
    made.update(batch, "d")
    after = {r["entity"]: r for r in made.table().collect()}
    assert all(after[k]["split"] == v for k, v in named.items())
    assert after["1:new"]["split"] == after["0:p900"]["split"] == splits.QUARANTINE
    assert after["1:follows"]["split"] == "train" and after["1:follows"]["component"] == after[f"0:p{c}"]["component"] == after[f"1:q{d}"]["component"]
    assert {r["split"] for r in made.conflicts().collect()} == {"train", "test"}
    got = [r["split"] for r in made.assign(batch).collect()]
    assert sorted(map(str, got)) == ["None", "quarantine", "quarantine", "quarantine", "train", "train"]
    made.update(spark.createDataFrame([(f"p{d}", "later", "z")], schema), "d")
    assert {r["entity"]: r["split"] for r in made.table().collect()}["1:later"] == "train"


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 1025):
        assert sorted(mixing.permuted(np.arange(n), n, 12345 + (3 << 40)).tolist()) == list(range(n))


def test_mix(spark):
    docs = spark.createDataFrame([(i, "word " * (50 + i % 30), ["A", "B", "C", None][i % 4] if i % 10 else "A") for i in range(400)] + [(1000, None, "A"), (1001, "", "B"), (1002, "word " * 9000, "B")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("A", 0.5, 2), ("B", 0.3, 1), ("D", 0.1, 4), ("C", 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed, pages = mixing.mix(docs, targets, block=64, per_shard=100)
    pieces = mixed.collect()
    used = Counter((r["source"], r["block"], r["doc_id"], r["tok_from"]) for r in pieces)
    assert max(v for k, v in used.items() if k[0] != "A") == 1 and max(used.values()) <= 2
    assert len({(r["shard"], r["slot"]) for r in pieces}) == len({(r["shard"], r["slot"], r["source"], r["block"]) for r in pieces})
    cover = Counter()
    for source, block, doc, _ in {(k[0], k[1], k[2], k[3]) for k in used}:
        cover[source] += 1
    got = {r["source"]: r for r in mixing.report(mixed, pages, targets).collect()}
    filled = sum(got[s]["out_tokens"] for s in "ABC")
    for s, share in (("A", 0.5), ("B", 0.3), ("C", 0.1)):
        assert abs(got[s]["out_tokens"] / filled - share / 0.9) < 0.02
    assert got["D"]["out_tokens"] == 0 and got["D"]["n_pages"] == 0
    assert all(got[s]["most_page_uses"] <= got[s]["max_repeats"] for s in "ABC")
    enc = bpe.encoder(bpe.vocabulary_path())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = {(r["shard"], r["slot"]): r["ids"] for r in mixing.packed(mixed, docs).collect()}
    sizes = Counter()
    for r in pieces:
        sizes[r["shard"], r["slot"]] += r["tok_to"] - r["tok_from"]
        part = enc.encode(texts[r["doc_id"]])[r["tok_from"] : r["tok_to"]]
        assert any(ids[r["shard"], r["slot"]][i : i + len(part)] == list(part) for i in range(64))
    assert {k: len(v) for k, v in ids.items()} == dict(sizes) and max(sizes.values()) == 64
    none, pages = mixing.mix(docs.where("false"), targets)
    assert none.count() == 0 and mixing.report(none, pages, targets).count() == 4


def test_blocks_hold_each_token_once(spark):
    pages = spark.createDataFrame([(i, "s", 7 * i % 23) for i in range(200)], "doc_id long, source string, n_tokens long")
    pieces = mixing.block_pieces(pages, 10).collect()
    per_block = Counter()
    for r in pieces:
        per_block[r["block"]] += r["tok_to"] - r["tok_from"]
    sizes = [per_block[b] for b in range(len(per_block))]
    assert set(sizes[:-1]) == {10} and sum(sizes) == sum(7 * i % 23 for i in range(200))
    by_doc = Counter()
    for r in pieces:
        by_doc[r["doc_id"]] += r["tok_to"] - r["tok_from"]
    assert all(by_doc[i] == 7 * i % 23 for i in range(200))


# 1


CLASSES = {"BENIGN": 1, "Bot": 2, "DoS Hulk": 5, "SSH-Patator": 12, "Web Attack - XSS": 15, "DDoS": 3, "DoS slowloris": 7}


def test_labels():
    m = labels.Matcher(CLASSES, labels.ALIASES)
    for text, want in {
        "benign": 1, "B3NIGN – geprüft": 1, "BEINGN (2)": 1, "label=BENIGN: x": 1, "Benign  Traffic Ã¢â‚¬â€œ ÃƒÂ\xa0 revoir": 1, "hulk": 5, "DoS/Hulk [a]": 5, "d0s hulk": 5, "ssh�patator": 12,
        "label: DoS Hulk": 5, "possible DoS Hulk": 5, "verdict: DoS Hulk": 5, "suspected DoS Hulk": 5, "Verdacht DoS Hulk": 5, "please check DoS Hulk": 5, "DoS Hulk seen at noon": 5, "not sure": -1, "lost robot": -1, "misc - not": -1,
        "x.s.s. web": 15, "web attack_xss": 15, "DDoS slowloris": 7, "D.D.o.S.": 3, "a bot": 2, "none of these": -1, "???": -1, "0": -1, "unknown": -1, "lost laptop": -1, "x" * 100_000: -1,
    }.items():
        assert m(text) == want, text


def test_automaton_against_distances():
    def distance(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rnd = random.Random(6)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 12))): i for i in range(60)}
    trie = labels.Trie({w: [i, i + 1000] for w, i in words.items()})
    for _ in range(200):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 13)))
        want = {(distance(w, e), i) for e, n in words.items() if distance(w, e) <= labels.reach(len(e)) for i in (n, n + 1000)}
        assert {(d, i) for d, i, _ in trie.near(w)} == want


def test_map_values(spark):
    df = spark.createDataFrame([(1, "BENIGN", 0), (2, None, 0), (3, " \t ", 0), (4, "benign", 0), (4, "benign", 0), (5, "zzz", 0)], "record_id long, label string, __name int")
    entries = spark.createDataFrame([(v, k) for k, v in CLASSES.items()], "class_id int, class_name string")
    assert rows(labels.map_values(df, "record_id", "label", entries, "class_id", "class_name")) == [(4, 1), (4, 1), (5, -1)]
    assert {r[1] for r in labels.map_values(df, "record_id", "label", entries.where("false"), "class_id", "class_name").collect()} == {-1}
    assert labels.map_values(df.where("false"), "record_id", "label", entries, "class_id", "class_name").count() == 0


def test_long_lists_and_learned_words(monkeypatch):
    monkeypatch.setattr(labels, "TRIE_ENTRIES", 5)
    m = labels.Matcher(CLASSES, labels.ALIASES)
    assert len(m.tries) > 5 and m("DoS slowlorsi") == labels.Matcher(CLASSES, {})("DoS slowlorsi") == 7
    plain, taught = labels.Matcher(CLASSES, {}), labels.Matcher(CLASSES, {}, frozenset(["foo", "bar"]))
    assert plain.neighbours("foo DoS Hulk bar") == (True, {"foo", "bar"}) and plain.neighbours("tag: DoS Hulk, remark") == (True, set())
    assert plain("foo bar foo DoS Hulk bar") == -1 and taught("foo bar foo DoS Hulk bar") == 5


# 2


REMARKS = ["très sûr", "zurückgestellt", "§ 4 erledigt", "mañana", "ночная смена", "πρόχειρο", "łącze zapasowe", "à revoir", "« douteux »", "NÃO CONFIRMADO", "ÂGE INCONNU", "Årsmøte", "±5 min"]


def garble(text, written, read):
    try:
        return text.encode(written).decode(read)
    except UnicodeError:
        return None


def test_garbled_text_round_trip(spark):
    data, want, i = [], {}, 0
    for rep in range(6):
        for r in REMARKS:
            label = f"BENIGN – {r}"
            data.append((i, label, f"f{rep % 2}", 0))
            i += 1
            for written, read in [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("utf-8", "cp1251")]:
                bad = garble(label, written, read)
                if bad and bad != label:
                    data.append((i, bad, f"f{rep % 2}", 0))
                    want[i] = label
                    i += 1
        data += [(i, "Bot � x", "f0", 0), (i + 1, "plain", "f0", 0), (i + 2, None, None, 0), (i + 3, "", "f1", 0)]
        want[i] = ""
        i += 4
    twice = garble(garble("BENIGN – confirmé", "utf-8", "cp1252"), "utf-8", "cp1252")
    data += [(i, twice, None, 0), (i + 1, "señal dÃ©bil", "f0", 0)]
    want |= {i: "BENIGN – confirmé", i + 1: "señal débil"}
    df = spark.createDataFrame(data, "record_id long, label string, source_file string, restored int")
    got = {r["record_id"]: r["restored"] for r in mojibake.find_garbled(df, "record_id", "label", "source_file").collect()}
    assert set(got) == set(want)
    assert sum(got[k] != v for k, v in want.items()) <= 0.03 * len(want)
    assert mojibake.find_garbled(df.where("false"), "record_id", "label", "source_file").count() == 0
    two = mojibake.find_garbled(df.withColumn("remark", F.lit("plain")), "record_id", ["label", "remark"], "source_file")
    assert {r["record_id"]: r["restored"] for r in two.collect()} == got and {r["field"] for r in two.collect()} == {"label"}


# 10


def test_words_are_folded():
    for a, b in [("S c h w e i n", "Schwein"), ("c**k", "c—k"), ("sch.wein", "schwein"), ("CA8RÓN", "cabrón"), ("ſhit", "shit"), ("en-\nchè¬\nres", "enchères"), ("modern", "modem"), ("roa■d", "road")]:
        assert abuse.words(a) == abuse.words(b), (a, b)
    assert abuse.words("idіоt") == abuse.words("idiot") and abuse.words("ty głupia świnio") == abuse.words("ty glupia swinio")
    cyrillic = abuse.words("Иди к чёрту, ты свинья")
    assert len(cyrillic) == len(set(cyrillic)) == 5 and cyrillic == abuse.words("иди к чёрту ты\u200b свинья")
    assert abuse.features(None) == set() == abuse.features("")


def test_chain_on_held_out_documents(spark):
    rnd = random.Random(8)
    bad = {"abusive": ["rot in a ditch you greasy toad", "shut your mouth imbecile"], "hateful": ["the ostlanders breed like rats and should be driven out"], "sexual": ["she stripped and moaned for more all night"]}
    good = ["the clerk read a letter from the town council", "wheat sold at thirty shillings the quarter", "the prize bitch of the pack was much admired", "a train was late at the station", "a toad was found in the ditch"]
    docs, labs = [], []
    for i in range(600):
        parts = [rnd.choice(good) for _ in range(6)]
        kind = rnd.choice(list(bad)) if i % 4 == 0 else None
        if kind:
            parts.insert(rnd.randint(0, 6), rnd.choice(bad[kind]))
        docs.append((i, ". ".join(parts), "src"))
        if i < 400:
            labs.append((i, int(bool(kind)) ^ (rnd.random() < 0.04), kind or "none"))
    docs += [(1000, None, None), (1001, "", "src"), (1002, "  \n", "src"), (1003, "word " * 60_000, "src")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    chain = abuse.fit_chain(d, spark.createDataFrame(labs, "doc_id long, verdict int, category string"))
    got = {r["doc_id"]: r for r in abuse.score_documents(d, chain, ("doc_id", "source")).collect()}
    hit = [got[i]["flagged"] == (i % 4 == 0) for i in range(400, 600)]
    assert sum(hit) >= 195
    assert all(got[i]["score"] == 0 and not got[i]["flagged"] for i in (1000, 1001, 1002))
    assert {r["source"]: r["n_documents"] for r in abuse.rates(abuse.score_documents(d, chain, ("doc_id", "source"))).collect()} == {None: 1, "src": 603}
    other = abuse.fit_chain(d.repartition(7), spark.createDataFrame(labs, "doc_id long, verdict int, category string").repartition(3))
    assert other.index == chain.index and other.threshold == chain.threshold and np.array_equal(other.weights, chain.weights)
    alone = abuse.fit_chain(d, spark.createDataFrame([], "doc_id long, verdict int, category string"))
    assert abuse.score_documents(d.where("false"), alone).count() == 0
