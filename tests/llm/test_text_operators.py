"""Quality ledger, mix, secrets, tokens and pseudonyms against brute force and on edge cases."""

import collections
import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe, mixing, pii, quality, secret_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "x\ny\nx\n\n \nx", "# a $ b\n# a", "é ü\x0bß", "w " * 300, "A B C D", "🙂 a 🙂 a 🙂", "1 2 3 1 2 4 1 2 3"]


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def ledger_of(text):
    t = text or ""
    w = WORD.findall(t)
    windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab #\n\té🙂", max_size=60)), max_size=12))
def test_measures(spark, texts):
    got = quality.measure(docs(spark, TEXTS + texts)).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [ledger_of(t) for t in TEXTS + texts]


def test_colliding_window_hashes_take_the_string_path(spark, monkeypatch):
    steps = tuple((n, e.replace("xxhash64(w, get(_words, i + 1), get(_words, i + 2))", "bigint(length(w))")) for n, e in quality.STEPS)
    monkeypatch.setattr(quality, "STEPS", steps)
    texts = [t for t in TEXTS if t] + ["a b c d e f a b c"]
    got = quality.measure(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in got] == [ledger_of(t)[4] for t in texts]


def test_policies_and_ablations(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    texts = [clean, clean + " ### $$$ %%% &&& *** ###", "short", ("a b c " * 40).strip(), None]
    book = quality.ledger(docs(spark, texts))
    assert [r.doc_id for r in quality.apply_policy(book, quality.STANDARD).collect()] == [0]
    assert [r.doc_id for r in quality.apply_policy(book, quality.BASE).orderBy("doc_id").collect()] == [0, 1]
    table = {(r.policy, r.without): (r.kept, r.dropped) for r in quality.ablations(book, quality.BASE, quality.STANDARD).collect()}
    assert table["standard", ""] == (1, 4) and table["standard", "symbol_heavy"] == (2, 3) and table["base", "too_few_words"][0] == 4
    older = book.selectExpr("* except (ruleset)", "'older' as ruleset")
    both = quality.ablations(book.unionByName(older), quality.BASE).where("without = ''").collect()
    assert {(r.ruleset, r.kept) for r in both} == {(quality.RULESET, 2), ("older", 2)}
    assert quality.ledger(docs(spark, TEXTS).limit(0)).count() == 0
    assert quality.ledger(docs(spark, ["x"]).selectExpr("doc_id", "text", "1 as n_words", "2 as failed")).columns.count("failed") == 1


def test_mix_is_near_its_targets(spark):
    rng = random.Random(3)
    sources = ["hot"] * 6 + ["a", "b", "ü", None]
    texts = [" ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 7, 40]))) if rng.random() > 0.02 else None for _ in range(600)]
    df = docs(spark, texts, sources)
    rows = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken, r.position or -1) for r in rows) == sorted((r.doc_id, r.taken, r.position or -1) for r in again)
    total, by = sum(r["size"] for r in rows), collections.defaultdict(list)
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 3 * r["size"]
        by[r.source].append(r)
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    size = {s: sum(r["size"] for r in by[s]) for s in order}
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * size[s] if s in capped else weight[s] * rest / share for s in order}
        over = {s for s in order if target[s] > 3 * size[s]} - capped
        if not over:
            break
        capped |= over
    for s in order:
        assert abs(by[s][0].target - target[s]) < 1e-6 and abs(sum(r.taken for r in by[s]) - target[s]) <= 1
    positions = [r.position for r in rows if r.position is not None]
    assert all(0 <= p <= 1 for p in positions)


def test_mix_edges(spark):
    assert mixing.mix(docs(spark, ["x"]).limit(0)).count() == 0
    blank = mixing.mix(docs(spark, [None, "", " "])).collect()
    assert {(r["size"], r.target, r.taken, r.position) for r in blank} == {(0, 0.0, 0, None)}
    twice = docs(spark, ["a b c"]).union(docs(spark, ["a b c"]))
    assert sum(r.taken for r in mixing.mix(twice).collect()) == 6
    assert mixing.mixed_documents(docs(spark, ["a b", "c d e"])).columns == docs(spark, ["x"]).columns


def spans_of(text):
    out = []
    for kind, (pattern, _, _, strong) in secret_links.KINDS.items():
        if strong:
            for m in re.finditer(pattern, text or ""):
                if kind != "assign" or len(m.group(1)) >= 8:
                    out.append((m.start(), list(secret_links.KINDS).index(kind), m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


SECRETS = [None, "", "é token = 'abcdefgh1'", "password: \"token\": abcdefghij", "AKIA" + "B" * 11, "xAKIA" + "B" * 12, "a" * 31 + " " + "f" * 32, "API_KEY=" + "0" * 40, "🙂Secret:\"short\" token:longer12"]


def test_base_spans(spark):
    got = secret_links.scan(docs(spark, SECRETS)).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in sorted(r.base, key=lambda s: (s.start, s.rank))] for r in got] == [spans_of(t) for t in SECRETS]


def test_weak_parts_need_company(spark):
    part = "wJalrXUtnFEMI7K7MDENGbPxRfiCY"
    texts = [f"AKIA{'B' * 12} {part} https://s3.example.com/x", part, f"username=bobby {part}", f"username=bobby at https://h.example.com {part}", f"AKIA{'B' * 12} {'x ' * 400}{part}", "https://a.example.com username=bobby"]
    got = secret_links.scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [[s.kind for s in r.spans] for r in got] == [["access", "part", "host"], [], [], ["id", "host", "part"], ["access"], []]
    assert secret_links.scan(docs(spark, texts).limit(0)).count() == 0


def test_redaction(spark):
    texts = [*SECRETS, f"a token=\"{'0a' * 20}\" b"]
    got = secret_links.redact(docs(spark, texts)).orderBy("doc_id").collect()
    assert got[-1].text == 'a [SECRET]" b' and got[0].text is None and got[1].text == ""
    assert all(not spans_of(r.text) for r in got) and secret_links.redact(docs(spark, texts)).columns == docs(spark, texts).columns


ODD = ["ΑΣ ΣΑΣ İ͊I ẞ ﬁ", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>", "it's 'S don't'll ''re'", "\x1c a\x85b\xa0c​ d　e", "१२3 ²½ Ⅷ", "漢字かな 한국어 😀", "\x00\x01a b", "é ̈́"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=50), min_size=1, max_size=60))
def test_tokens_are_the_library_s(spark, tokenizer, texts):
    texts = ODD + TEXTS + texts
    for r in bpe.encode_decode(docs(spark, texts), bpe.default_path()).collect():
        want = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == tokenizer.decode(want, skip_special_tokens=False)


def test_the_query_s_hashes(spark, tokenizer, tmp_path):
    texts = [*ODD, *TEXTS, "it's A text " * 4000]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(tuple(r) for r in bpe.op6(spark, str(tmp_path)).collect()) == want


def test_another_tokenizer_file(tmp_path, tokenizer):
    """Special tokens and the pattern are those of the file; one of another build is refused."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    with open(bpe.default_path()) as f:
        made = json.load(f)
    made["added_tokens"] = [{**made["added_tokens"][0], "content": "[[cut]]"}]
    made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]"
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(made, f)
    other, split = Tokenizer.from_file(path), bpe.Splitter(path)
    for text in ("a 12 b!? [[cut]]c é9", "x'll [[cut]] <|endoftext|>"):
        ids = [i for w in split(text) for i in ([split.specials[w]] if w in split.specials else other.encode(w, add_special_tokens=False).ids)]
        assert ids == other.encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        bpe.Splitter(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_beyond_the_table_are_encoded_alike(spark, monkeypatch):
    df = docs(spark, ODD + [" ".join(f"w{i}x" for i in range(300)) + " the the"])
    whole = [r.ids for r in bpe.encode_decode(df, bpe.default_path()).orderBy("doc_id").collect()]
    monkeypatch.setattr(bpe.frequent, "__defaults__", (3,))
    assert [r.ids for r in bpe.encode_decode(df, bpe.default_path()).orderBy("doc_id").collect()] == whole
    back = bpe.decode(bpe.encode_decode(df, bpe.default_path(), decode=False), bpe.default_path())
    assert back.orderBy("doc_id").first()["decoded"] and bpe.encode_decode(df.limit(0), bpe.default_path()).count() == 0


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


def test_pseudonyms_keep_their_formats(spark):
    rng = random.Random(5)
    cards = []
    while len(cards) < 60:
        s = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if luhn(s):
            cards.append(s)
    ssns = [f"{a:03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for a in (1, 665, 667, 899, *rng.sample(range(1, 600), 40))]
    dates = ["1900-01-01", "2099-12-31", "2000-02-29", "12/25/1980", "31.12.1999", "2024/02/29"]
    phones = ["+1 (743) 555-3824", "212-555-0100", "(212) 555-0100"]
    ips = [f"{rng.randint(0, 255)}.{rng.randint(0, 255)}.3.4" for _ in range(20)]
    values = cards + ssns + dates + phones + ips + ["bob.smith@x.example.com", "a1@y.org"]
    df = docs(spark, [f"<{v}> and again {v}!" for v in values])
    new = [r.text for r in pii.pseudonymise(df, "k1").orderBy("doc_id").collect()]
    out = []
    for v, t in zip(values, new, strict=True):
        a, b = re.fullmatch(r"<(.*)> and again (.*)!", t).groups()
        assert a == b
        out.append(a)
    assert sum(a != v for a, v in zip(out, values, strict=True)) > len(values) - 5
    assert all(luhn(a) and a[0] == "4" and len(a) == 16 for a in out[:60]) and len(set(out[:60])) == 60
    for a in out[60 : 60 + len(ssns)]:
        area, group, serial = a.split("-")
        assert 1 <= int(area) <= 899 and int(area) != 666 and int(group) > 0 and int(serial) > 0
    assert all(re.sub(r"\d", "9", a) == re.sub(r"\d", "9", v) for a, v in zip(out, values, strict=True) if v in dates + phones)
    assert out[-2].endswith("@x.example.com") and re.fullmatch(r"[a-z]{3}\.[a-z]{5}", out[-2].split("@")[0])
    other = [r.text for r in pii.pseudonymise(df, key="k'2").orderBy("doc_id").collect()]
    assert other != new


NEIGHBOURS = [
    ["234-56-7890", "555-223-4567"], ["212-555-0100", "415-555-0199"], ["5", "4111111111111111"], ["2024-05-01", "4111 1111 1111 1111"], ["2024-01-01", "2024-02-02"],
    ["4111111111111111", "5500-0000-0000-0004", "234-56-7890", "12"], ["12 34 4111-1111-1111-1111", "bob@x.org"], ["7 4111111111111111@x.org"], ["10.0.0.4", "4111 1111 1111 1111", "10.0.0.5"],
    ["999-99-9999", "4111111111111111", "2023-02-30", "2000-02-29", "1900-02-29"], ["3782 822463 10005", "2024/12/31", "+1 (743) 555-3824", "5500000000000004"],
]


def test_neighbours_are_found_as_if_alone(spark):
    values = sorted({v for row in NEIGHBOURS for v in row})
    alone = dict(zip(values, pii.pseudonymise(docs(spark, values), "k1").orderBy("doc_id").collect(), strict=True))
    got = pii.pseudonymise(docs(spark, ["see " + " ".join(row) + "." for row in NEIGHBOURS]), "k1").orderBy("doc_id").collect()
    for row, r in zip(NEIGHBOURS, got, strict=True):
        assert r.text == "see " + " ".join(alone[v].text for v in row) + "."
        assert all(r[f"n_{k}"] == sum(alone[v][f"n_{k}"] for v in row) for k in pii.KINDS), row
    still = {"5", "12", "999-99-9999", "2023-02-30", "1900-02-29"}
    assert {v for v in values if alone[v].text == v} == still


def test_any_area_in_explicit_form(spark):
    phones = [f"+1 ({a:03d}) 555-77{a % 100:02d}" for a in (0, 17, 99, 100, 199, 200, 743, 999)]
    got = pii.pseudonymise(docs(spark, [*phones, "(743) 555-7743", "(017) 555-7717"]), "k1").orderBy("doc_id").collect()
    new = [r.text for r in got]
    assert all(re.fullmatch(r"\+1 \([0-9]{3}\) [2-9][0-9]{2}-[0-9]{4}", x) and x != v and r.n_phone == 1 for x, v, r in zip(new, phones, got, strict=False)) and len(set(new)) == len(new)
    assert [x[4] < "2" for x in new[:8]] == [v[4] < "2" for v in phones] and new[6] == "+1 " + new[8] and new[9] == "(017) 555-7717"


def test_long_runs_of_numbers(spark):
    cards = ["4111111111111111", "5500000000000004"] * 300
    text = " ".join(f"7 {c} 1" for c in cards)
    r = pii.pseudonymise(docs(spark, [text, "1 " * 20000]), "k1").orderBy("doc_id").collect()
    assert r[0].n_card == 600 and not set(r[0].text.split()) & set(cards) and r[1].n_card == 0 and r[1].text == "1 " * 20000


def test_date_pattern_is_the_calendar():
    import datetime

    for form, shape in (("%Y-%m-%d", "{0:04d}-{1:02d}-{2:02d}"), ("%d.%m.%Y", "{2:02d}.{1:02d}.{0:04d}")):
        pattern = re.compile(pii._dates(form.replace(".", r"\.")))
        for y in (1899, 1900, 1904, 1999, 2000, 2023, 2024, 2096, 2099, 2100):
            for m in range(14):
                for d in range(33):
                    try:
                        good = datetime.date(y, m, d).year in range(1900, 2100)
                    except ValueError:
                        good = False
                    assert bool(pattern.fullmatch(shape.format(y, m, d))) == good


def test_a_small_domain_is_permuted(spark):
    got = spark.range(17 * 4297).selectExpr(pii._pair("id div 4297", "id % 4297", "17", "4297", "t", "k") + " as p").selectExpr("p.a * 4297 + p.b as v").distinct()
    assert got.count() == 17 * 4297


def test_what_is_not_valid_stays(spark):
    texts = ["4111111111111112", "000-12-3456", "666-12-3456", "2023-02-30", "1850-01-01", "999.1.1.1", "25/12/1980", None, "", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "2125550100"]
    got = pii.pseudonymise(docs(spark, texts), "k1").orderBy("doc_id").collect()
    assert [r.text for r in got] == texts and all(r[f"n_{k}"] == 0 for r in got for k in pii.KINDS)
    assert pii.pseudonymise(docs(spark, texts).limit(0), "k1").count() == 0


def test_digests(spark):
    assert hashlib.sha256(b"").hexdigest() == secret_links.scan(docs(spark, [None])).selectExpr(f"sha2({secret_links._listed('base')}, 256) as h").first()["h"]
