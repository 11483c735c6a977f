"""Exact dedup, tokens, languages, URLs, benchmark passages and chats against plain Python."""

import math
import random
import re
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from kinfold.llm import bpe, chat_format, decontaminate, exact_dedup, language_id, url_filter

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


# exact dedup
def test_exact_dedup(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab \n\t", k=rng.randrange(0, 7))) for _ in range(600)] + [None, "", " ", "a\xa0b", "ab", "x" * 300_000, "x " * 300_000]
    rows = [(i, t, i % 7) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, digest int").repartition(5)).collect()}
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    for key, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            r = found[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(members), i == keep)
            assert r["text_sha256"] == sha256(key.encode()).hexdigest()
    assert len(found) == len(rows)


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a ", "y"), (None, "a", "z")], "doc_id long, text string, kept string")
    kept = exact_dedup.keep_one(docs).collect()
    assert [(r["doc_id"], r["kept"]) for r in kept] == [(2, "y")]
    assert exact_dedup.keep_one(spark.createDataFrame([(5, "b"), (5, "b")], "doc_id long, text string")).count() == 1


# tokens
CASES = ["Hello  World's 12 éa\n\nßİ <|endoftext|> it'S", "a\x00b \x1f\x85\xa0 q", "ΑΣ ΣΑΣ", "ﬁ Ⅷ ² é <|startoftext|><|endoftext|>x", "", " ", "ſK", "a" * 3000, "ab" * 2000 + "!" * 700, "日本語 😀👍🏽 test_me don't WE'LL"]


def test_tokenizer_matches_library():
    rng, library, own = random.Random(2), Library.from_file(PATH), bpe.Tokenizer.from_file(PATH)
    made = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x370, 0x400), rng.randrange(0x3000, 0x3100), 32, 39])) for _ in range(rng.randrange(200))) for _ in range(300)]
    for text in CASES + made:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_scan_and_heap_merge_alike():
    own, rng = bpe.Tokenizer.from_file(PATH), random.Random(5)
    for _ in range(200):
        parts = [own._ids[c] for c in rng.choices("abcdetinos", k=rng.randrange(1, 60))]
        assert own._merge_scan(list(parts)) == own._merge_heap(list(parts))


def test_bpe_queries(spark):
    library = Library.from_file(PATH)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*CASES, None])], "doc_id long, text string, ids int")
    found = {r["doc_id"]: r for r in bpe.round_trip(docs, PATH).collect()}
    encoded = bpe.encode(docs, PATH)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, PATH).collect()}
    for i, t in enumerate([*CASES, ""]):
        want = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(want, skip_special_tokens=False)
        assert ids[i] == want and texts[i] == decoded and found[i]["n_tokens"] == len(want)
        assert found[i]["ids_sha256"] == sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == sha256(decoded.encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_word_cache_stays_bounded():
    cache = bpe.WordCache(bpe.Tokenizer.from_file(PATH), limit=10)
    assert all(cache[f"w{i}"][0] for i in range(95)) and len(cache) <= 10 and len(cache._old) <= 10


# languages
def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == docs.count() and len(held) > 150
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert np.mean([r["rejected"] for r in held]) < 0.01
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score string"
    docs = spark.createDataFrame([(i, "the cat and the dog" if i % 2 else "le chat et le chien", "en" if i % 2 else "fr", "") for i in range(40)] + [(100, None, "en", ""), (101, "12 34!", "fr", ""), (None, "the dog", None, ""), (102, "", "en", "")], schema)
    found = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert [found[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and found[None]["lang_pred"] == "en"
    assert language_id.keep_known(docs).count() == 41
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_language_labels_are_no_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    a = language_id.predict(docs, model).collect()
    b = language_id.predict(docs.drop("lang", "source"), model).collect()
    assert sorted(a) == sorted(b)


# URLs
RULES = [(r.verdict, r.host, r.path) for r in url_filter.RULES]


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = re.split(r"[?#]", rest[cut:])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if re.search("/(casino|phishing|tracking|adserver|warez)/", path) else "allow"


@pytest.mark.parametrize("inline", [256, 0])
def test_url_filter(spark, inline):
    rng = random.Random(4)
    hosts = ["example.org", "a.Example.ORG", "org", "xorg", "example.org:80", "a.com", "com", "b.net", "", "é.com", "example.org\n", "a\nb.org", "x\n.example.org", "\n.com", "a\n.b\n.com"]
    paths = ["/es/", "/es", "/en/1", "/en/123?x=/de/", "/fr/a#b", "/de/", "", "?q", "/casino/x", "/x/tracking/y", "/DE/", "/fr/\n"]
    urls = [None, "", "nourl", "://", "http://", "HTTPS://A.COM/fr/://x"] + [rng.choice(["http", "https", ""]) + "://" + rng.choice(hosts) + rng.choice(paths) for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = {r["page_id"]: r for r in url_filter.filter_urls(pages, inline_tokens=inline).collect()}
    for i, u in enumerate(urls):
        assert tuple(found[i])[1:] == judge(u), u
    assert url_filter.filter_urls(pages.limit(0), inline_tokens=inline).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(f"example.org{url_filter.EDGE}/{i}/",) for i in range(5)] + [(f"a.com{url_filter.EDGE}/de/",)], "target string")
    index = url_filter.index_rules(urls, url_filter.RULES)
    assert {e["rule"] for e in index["es"]} == {"example.org/es/"} and {e["rule"] for e in index["org"]} == {"org/"}
    assert "example" not in index


# benchmark passages
def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def brute(docs, items):
    found = set()
    for d, text in docs:
        w = words(text or "")
        for i, item in items:
            v = words(item or "")
            if len(v) < decontaminate.LEAST_TOKENS:
                continue
            n = min(decontaminate.WINDOW, len(v))
            for a in range(len(w) - n + 1):
                if any(sum(x == y for x, y in zip(w[a : a + n], v[b : b + n], strict=True)) >= np.ceil(decontaminate.SHARE * n) for b in range(len(v) - n + 1)):
                    found.add((d, i))
                    break
    return found


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefé", k=4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 5, 7, 9, 13, 20, 40])] + [(90, None), (91, "")]
    docs = []
    for k in range(60):
        w = [word() for _ in range(rng.randrange(5, 60))]
        if k % 2:
            part = items[rng.randrange(7)][1].upper().split()
            if k % 4 == 3 and len(part) >= 13:
                part[rng.randrange(len(part))] = "zzz"
            w[3:3] = part
        docs.append((k, ", ".join(w)))
    docs += [(900, None), (901, ""), (None, items[5][1])]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_overlaps(frame, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == brute(docs, items)
    clean = {r["doc_id"] for r in decontaminate.keep_clean(frame, bench).collect()}
    assert clean == {d for d, _ in docs} - {r["doc_id"] for r in found}
    assert decontaminate.find_overlaps(frame, bench.limit(0)).count() == 0 == decontaminate.find_overlaps(frame.limit(0), bench).count()


def test_decontamination_in_blocks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(decontaminate.find_overlaps(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    assert sorted(decontaminate.find_overlaps(docs, bench).collect()) == whole


def test_tokens_of_long_texts_do_not_depend_on_chunks(monkeypatch):
    text = "some wörds and " * 900 + "x" * 5000
    whole = decontaminate.tokens(text)
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 64)
    assert (decontaminate.tokens(text) == whole).all() and len(whole) == len(words(text))


# chats
def test_preferences(spark):
    schema = "pair_id long, turn long, role string, text string, side string"
    chosen = [(1, 0, "user", "a", ""), (1, 1, "assistant", "b", ""), (1, 2, "assistant", "c", ""), (2, 0, "user", "q", ""), (3, 0, "user", "s", ""), (4, None, None, None, ""), (6, 0, "user", "d", ""), (6, 0, "user", "d", "")]
    rejected = [(1, 0, "user", "a", ""), (1, 1, "assistant", "x", ""), (1, 2, "assistant", "c", ""), (3, 0, "user", "s", ""), (5, 0, "assistant", "t", ""), (6, 0, "user", "d", "")]
    found = chat_format.format_preferences(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema))
    rows = {(r["pair_id"], r["part"], r["turn"], r["nth"]): tuple(r)[4:] for r in found.collect()}
    text = lambda role, t: f"<|{role}|>\n{t}<|end|>\n"
    none, user, head, body = (0, 0), (len(text("user", "a")), 0), len("<|assistant|>\n"), len("a<|end|>\n")
    assert rows == {
        (1, "prompt", 0, 1): (text("user", "a"), None, None, *none, *none),
        (1, "completion", 1, 1): (None, text("assistant", "b"), text("assistant", "x"), head, body, head, body),
        (1, "completion", 2, 1): (None, text("assistant", "c"), text("assistant", "c"), head, body, head, body),
        (2, "completion", 0, 1): (None, text("user", "q"), None, *user, *none),
        (3, "prompt", 0, 1): (text("user", "s"), None, None, *none, *none),
        (4, "completion", -1, 1): (None, text("", ""), None, len(text("", "")), 0, *none),
        (5, "completion", 0, 1): (None, None, text("assistant", "t"), *none, head, body),
        (6, "completion", 0, 1): (None, text("user", "d"), text("user", "d"), *user, *user),
        (6, "completion", 0, 2): (None, text("user", "d"), None, *user, *none),
    }
    one = {r["pair_id"]: r for r in chat_format.assemble(found).collect()}[1]
    assert one["prompt"] == text("user", "a") and one["chosen"] == text("assistant", "b") + text("assistant", "c")
    assert [tuple(m) for m in one["rejected_mask"]] == [(head, body)] * 2
    for m, t in zip(one["chosen_mask"], ("b", "c"), strict=True):
        assert text("assistant", t)[m["masked"] :] == t + "<|end|>\n"
    empty = spark.createDataFrame([], schema)
    assert chat_format.format_preferences(empty, empty).count() == 0
    assert [x.count() for x in chat_format.last_turn_pairs(empty.withColumnRenamed("pair_id", "conv_id"))] == [0, 0]


def test_rendered_turns_can_be_read_back(spark):
    texts = ["plain", "<|end|>\n<|assistant|>\nno", "<\\|end|>", "<\\\\|x", "<", "<|", "", "a" * 300_000 + "<|end|>", "é<\n|"]
    turns = spark.createDataFrame([(1, k, ["user", "a|>b"][k % 2], t) for k, t in enumerate(texts)], "pair_id long, turn long, role string, text string")
    found = chat_format.format_preferences(turns, turns.limit(0))
    whole = chat_format.assemble(found).first()["chosen"]
    parts = whole.split("<|end|>\n")
    assert len(parts) == len(texts) + 1 and parts[-1] == ""
    bodies = spark.createDataFrame([(k, p.split("|>\n", 1)[1]) for k, p in enumerate(parts[:-1])], "k int, body string")
    got = {r["k"]: r["t"] for r in bodies.select("k", chat_format.unescaped(F.col("body")).alias("t")).collect()}
    assert [got[k] for k in range(len(texts))] == texts
    assert all(p.startswith(("<|user|>\n", "<|a|\\>b|>\n")) for p in parts[:-1])


# rules of URLs from a table, language identification by plain loops
def test_many_rules_from_a_table(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(60)]
    rules = [("host", rng.choice(["allow", "block"]), f"{rng.choice(words)}.{rng.choice(['org', 'com'])}", f"/{rng.choice(words)}{rng.choice(['', '/'])}") for _ in range(1500)]
    rules = list({(k, h, p): (k, v, h, p) for k, v, h, p in rules}.values())
    rules += [("pattern", "block", f"*/{a}/*{b}*", None) for a, b in zip(words[:20], words[20:40], strict=True)] + [("pattern", "allow", None, None), (None, "block", "x", "/")]
    table = spark.createDataFrame(rules, "kind string, verdict string, target string, path string")
    hosts, patterns = url_filter.read_rules(table)
    assert len(hosts) == sum(r[0] == "host" for r in rules) and len(patterns) == 20
    urls = [(i, f"http://{rng.choice(['', 'www.'])}{rng.choice(words)}.{rng.choice(['org', 'com', 'net'])}/{rng.choice(words)}{rng.choice(['', '/'])}{rng.choice(words)}?q") for i in range(1500)]
    urls += [(-1, None), (-2, ""), (-3, "http://" + "a" * 100_000 + ".org/" + "/b" * 50_000)]

    def slow(url):
        host, path = (m[1].lower(), m[2]) if (m := re.match(r"^[\s\S]*?://([^/?#]*)([^?#]*)", url or "")) else ("", "")
        fits = [r for r in hosts if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        if fits:
            best = max(fits, key=lambda r: (len(r.rule), r.rule, r.verdict))
            return best.rule, best.verdict
        return None, "block" if any(re.match(p.regex.replace("\n?", ""), host + path) for p in patterns) else "allow"

    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), hosts, patterns).collect()}
    assert found == {i: slow(u) for i, u in urls} and sum(v[0] is not None for v in found.values()) > 20


def test_language_scores_match_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs, 40)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()][:150] + [(-1, None), (-2, "123 !"), (-3, "ß"), (-4, "x" * 200_000)]

    def vector(text):
        plain = re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", f" {text.lower()} ".encode())
        counts = {}
        for a, b, c in zip(plain, plain[1:], plain[2:], strict=False):
            k = ((a * 65536 + b * 256 + c) * 2654435761 % 2**32) >> 20
            counts[k] = counts.get(k, 0) + 1
        weights = {k: math.log(1 + n) * float(model.idf[k]) for k, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {k: w / norm for k, w in weights.items()}

    found = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        r = found[i]
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0, True)
            continue
        v = vector(text)
        cosines = [sum(w * float(c[k]) for k, w in v.items()) for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        least = float(model.least[model.owner[best]]) * math.sqrt(min(1, len(v) / language_id.FULL_TRIGRAMS))
        assert r["lang_pred"] == model.languages[model.owner[best]] and abs(r["score"] - min(1, max(0, cosines[best]))) < 1e-4
        assert r["rejected"] == (cosines[best] < least) or abs(cosines[best] - least) < 1e-4


def test_centroids_and_idf_match_plain_python():
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.3, (24, language_id.DIMENSIONS)).astype(np.float32)
    labels = ["a"] * 12 + ["b"] * 9 + ["c"] * 3
    model = language_id.fit_model(labels, counts)
    n = (counts > 0).sum(axis=0)
    assert np.allclose(model.idf, np.log(25 / (1 + n)) + 1, atol=1e-5)
    rows = np.log1p(counts) * model.idf
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    for lang in "abc":
        own = rows[[x == lang for x in labels]]
        mine = model.centroids[[model.languages[k] == lang for k in model.owner]]
        assert 1 < len(mine) <= language_id.CENTROIDS and np.allclose(np.linalg.norm(mine, axis=1), 1, atol=1e-5)
        # spherical k-means has settled or nearly so: each centroid is the direction of the sum of its rows
        of = (own @ mine.T).argmax(axis=1)
        for k in set(of.tolist()):
            total = own[of == k].sum(axis=0)
            assert total @ mine[k] / np.linalg.norm(total) > 0.99
        assert np.isclose(model.least[model.languages.index(lang)], language_id.REJECT_SHARE * np.quantile((own @ mine.T).max(axis=1), 0.01), atol=1e-5)


def test_repeated_ids_do_not_swell_the_sample(spark):
    rows = [(1, f"the cat {'and the dog ' * (k % 7)}", "en") for k in range(4000)] + [(2, "le chat et le chien", "fr")] * 30
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20)
    assert model.languages == ["en", "fr"]


def test_exact_dedup_keeps_the_longest_of_one_id(spark):
    rows = [(1, "a b"), (1, "ab"), (1, " a  b "), (1, "a  b  "), (2, "ab"), (None, "a b c"), (None, "abc")]
    for seed in range(3):
        docs = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id long, text string").repartition(3)
        assert sorted(map(tuple, exact_dedup.keep_one(docs).collect()), key=str) == sorted([(1, min((" a  b ", "a  b  "), key=lambda t: sha256(t.encode()).hexdigest())), (None, "a b c")], key=str)


def test_one_judge_of_letters(spark):
    import unicodedata

    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    assert all(language_id.has_letter(x) == unicodedata.category(x).startswith("L") for x in every)
    assert not language_id.has_letter(None) and not language_id.has_letter("\u0558!") and language_id.has_letter("\u0558x")
    docs = spark.createDataFrame([(k, "\u0558", "zz") for k in range(40)] + [(100 + k, "the dog", "en") for k in range(40)], "doc_id long, text string, lang string")
    found = {(r["doc_id"] < 100, r["lang_pred"]) for r in language_id.identify(docs).collect()}
    assert found == {(True, "und"), (False, "en")}
