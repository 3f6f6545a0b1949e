"""Token counts, conversation repair, spelling variants, and spans against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventloom.llm import catalogue, conversations, privacy, secrets, spans, tokencounts, variants
from tests.llm import brute

SMALL = "/root/testdata/sf0.01"


# --- token counts ------------------------------------------------------------

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]
# Characters that compose, lower-case or end a word in different ways.
SIGNS = list("ab cAZ\n\t!?.019ÀÖßÿ×÷éÉ<|>~Åक़。中文　Σςİ") + [
    "́", "̀", "̧", "é", " ", " ", "\x1c", "\x0b", "\x85", "ᄀ", "ᅡ",
    "'s", "'RE", "  ", "<|endoftext|>", "<|startoftext|>",
]


def lengths(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t)) for t in texts]
    model = Tokenizer.from_file(path)
    return [len(model.encode(t, add_special_tokens=False)) for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_counts_are_those_of_the_library(name, monkeypatch):
    """Cuts and windows, with bounds small enough to matter in short texts."""
    monkeypatch.setattr(tokencounts, "LONG", 40)
    monkeypatch.setattr(tokencounts, "OVERLAP", 12)
    monkeypatch.setattr(tokencounts, "BATCH_BYTES", 300)
    rng = random.Random(1)
    texts = ["".join(rng.choices(SIGNS, k=rng.randint(0, 150))) for _ in range(1500)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(100, 600))) for _ in range(200)]
    texts += ["".join(rng.choices(["the", "ing", "er", "on"], k=300)) for _ in range(50)]
    texts += ["", "a" * 5000, "ab" * 4000, "x1" * 3000, "中文。" * 200, "The quick brown fox " * 50]
    assert tokencounts.counter(public_tokenizers.path(name)).counts(texts) == lengths(name, texts)


def test_every_file_is_cut():
    words, spaced, model = (tokencounts.counter(public_tokenizers.path(n)) for n in FILES)
    assert words.drops_blanks and spaced.keeps_blank and model.blank_in_front


def test_token_counts_on_edges(spark):
    long = "word's 12, " * 30_000
    rows = [(1, None), (2, ""), (None, "no id"), (3, long), (3, long), (4, "<|endoftext|>"), (5, "x" * 300_000), (6, "é " * 2048), (7, "é " * 2049)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_bytes string, n_tokens int")
    path = public_tokenizers.path(FILES[0])
    got = tokencounts.count_tokens(docs, path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    counts = lengths(FILES[0], [t or "" for _, t in rows])
    want = [(i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, counts, strict=True)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert [r[3] for r in want[-2:]] == [False, True]
    assert tokencounts.count_tokens(docs.where("false"), path).count() == 0


def test_token_query_agrees_with_the_library(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in catalogue.op11_tokens(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for r, n in zip(docs, lengths(FILES[0], [r["text"] or "" for r in docs]), strict=True):
        row = got[r["doc_id"]]
        assert (row["n_bytes"], row["n_tokens"]) == (len((r["text"] or "").encode()), n)


# --- conversations -----------------------------------------------------------

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(rows):
    """What the contract says of a table, sorted as text."""
    groups = defaultdict(list)
    for row in brute.damage(rows):
        groups[row[0]].append(row)
    found = []
    for conv_id in {r[0] for r in rows}:
        lines = sorted(groups[conv_id], key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        found.append((conv_id, *brute.repair(lines)) if lines else (conv_id, 0, 0, 0, 0, 0, 0, "", brute.digest("")))
    return sorted(map(repr, found))


def conversation_table(spark, rows):
    schema = "conv_id long, turn long, role string, text string, cost string, audit int, content int"
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)


def test_repairs_agree_with_all_ways(spark):
    """Short conversations of all kinds of rows; turns with gaps, missing and equal ones."""
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["One.", "Two!", "Three? ", "cut", " ", "", None, "a.b ", "\t\n", "ends.\x0b"]
    rows = []
    for conv_id in [None, *range(400)]:
        turn = rng.choice([-3, 0, 5])
        for _ in range(rng.randint(1, 9)):
            rows.append((conv_id, turn, rng.choice(roles), rng.choice(texts)))
            turn += rng.choice([1, 1, 1, 2, 4])
    rows += [(1000, None, "user", "Hm."), (1001, None, "user", "Hm."), (1001, 0, "assistant", "Hm."), (1002, None, None, None)]
    rows += [(1003, 7, "user", "Same."), (1003, 7, "user", "Same."), (1003, 8, "assistant", "Yes.")]
    rows += [(1004 + i, 0, "user", "Only one.") for i in range(60)]
    table = conversation_table(spark, rows)
    got = conversations.repair_conversations(table)
    assert got.columns == COLUMNS
    assert sorted(map(repr, map(tuple, got.collect()))) == repaired(rows)
    assert conversations.repair_conversations(table.where("false")).count() == 0


def test_conversation_query_agrees_with_all_ways(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = catalogue.op12_conversations(spark, SMALL)
    assert sorted(map(repr, map(tuple, got.collect()))) == repaired(rows)


def test_automaton_on_every_short_signature():
    """Signatures in any order share their ends only, and every sign may follow every other."""
    import itertools

    kinds = {"d": ("user", ""), "s": ("system", "."), "u": ("user", "."), "a": ("assistant", "."), "x": ("tool", ".")}
    kinds |= {k.upper(): (role, "-") for k, (role, text) in kinds.items() if k != "d"}
    known = conversations.Repairs()
    for n in range(5):
        for signature in map("".join, itertools.product(kinds, repeat=n)):
            rows = [(1, i, kinds[c][0], f"{i}{kinds[c][1]}" if c != "d" else "") for i, c in enumerate(signature)]
            want = brute.repair(rows) if rows else (0,) * 5 + (0, "")
            assert known.of(signature) == (want[5], want[6]), signature


def test_one_long_conversation(spark):
    """A path of many nodes, and others that share its end."""
    rng = random.Random(6)
    signs = [rng.choice(["user", "assistant"]) for _ in range(30_000)]
    rows = [(1, i, role, f"{i}.") for i, role in enumerate(signs)]
    rows += [(2, i, role, f"{i}.") for i, role in enumerate(signs[-500:])]
    got = conversations.repair_conversations(conversation_table(spark, rows)).collect()
    assert sorted(len(r["audit"].replace("I", "")) for r in got) == sorted(
        len([1 for r in brute.damage(rows) if r[0] == c]) for c in (1, 2)
    )


# --- spelling variants -------------------------------------------------------


def found_variants(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def test_variants_agree_with_all_pairs(spark):
    """Few letters, so that bigrams tie and repeat; words of every kind of difference."""
    rng = random.Random(7)
    letters = "aabcé"
    base = ["".join(rng.choices(letters, k=rng.randint(6, 11))) for _ in range(150)] + ["a" * n for n in range(6, 14)]
    words = list(base)
    for word in base:
        for _ in range(3):
            i = rng.randrange(len(word))
            words.append(rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i:], word[:i] + "x" + word[i + 1 :]]))
    docs = []
    for doc_id in range(40):
        text = "".join(rng.choice(words).title() + rng.choice([" ", ", ", "1", "\u0100", "中", "_"]) for _ in range(300))
        docs.append((doc_id, text + " " + " ".join(base[:3] * 60 + [base[0][:-1] + "y"] * 9)))
    docs += [(None, "Nobody's Wordless wordless"), (50, None), (51, ""), (52, "×÷ÀÿÀÿÀÿ ×÷ÀÿÀÿÀÿ ÀÀÀÀÀÀÀ"), (53, "short"), (53, "short"), docs[0], docs[0]]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    want = sorted(map(repr, brute.variants(docs)))
    assert found_variants(variants.spelling_variants(frame)) == want
    assert sum(r[1] is not None for r in brute.variants(docs)) > 20
    assert variants.spelling_variants(frame.where("false")).count() == 0


def test_chains_of_forms_lead_to_the_last(spark):
    """abcdefg (2000) <- abcdefgh (150) <- abcdefghi (12): damage takes some occurrences."""
    rows = [(i, " ".join(["abcdefg"] * 20 + ["abcdefgh"] * (i % 2 + 1) + ["abcdefghi"] * (i % 10 == 0))) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = variants.spelling_variants(frame)
    assert found_variants(got) == sorted(map(repr, brute.variants(rows)))
    roots = {r["word"]: (r["form"], r["root"]) for r in got.collect()}
    assert roots["abcdefghi"] == ("abcdefgh", "abcdefg")


def test_very_long_words(spark):
    """A text is cut between words; equal bigrams all over a long word stay linear."""
    long = "ab" * 20_000
    rows = [(i, f"{long} {long}c {'a' * 20_000} {'a' * 20_001} " + "wordnumber " * 1000) for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: r["n_near"] for r in variants.spelling_variants(frame).collect()}
    assert got[long] == got[long + "c"] and got["a" * 20_000] >= 1


def test_words_around_the_carried_length(spark):
    """Pairs with both, one or none of the words carried along with their entries."""
    rng = random.Random(8)
    rows = []
    for n in (63, 64, 65, 66):
        for _ in range(5):
            word = "".join(rng.choices("abcdefgh", k=n))
            at = rng.randrange(n)
            rows.append((len(rows), " ".join([word, word[:at] + "x" + word[at + 1 :], word[:at] + word[at + 1 :]] * 3)))
    got = variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found_variants(got) == sorted(map(repr, brute.variants(rows)))


def test_variant_query_agrees_with_all_pairs(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = found_variants(catalogue.op13_variants(spark, "/root/testdata/sf0.001"))
    assert got == sorted(map(repr, brute.variants([tuple(r) for r in rows.collect()])))


def test_two_texts_are_no_evidence(spark):
    """Two texts that share an address and rare words disclose nothing; four texts do."""
    rare = "beryl topaz zircon garnet spinel kyanite olivine"
    rows = [(i, f"ordinary words about nothing number{i} from somewhere") for i in range(200)]
    rows += [(300 + i, f"{n} note on {rare} ask m@mail.example.com") for i, n in enumerate(("first", "second"))]
    rows += [(400 + i, f"{n} memo of Quillon via q@mail.example.com") for i, n in enumerate("abcd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in privacy.redact(docs).collect()}
    assert clean[300] == f"first note on {rare} ask [EMAIL]" and clean[301] == f"second note on {rare} ask [EMAIL]"
    assert all("Quillon" not in clean[400 + i] and "[EMAIL]" in clean[400 + i] for i in range(4))
    assert all(clean[i] == text for i, text in rows[:200])


def test_the_map_of_terms_is_in_no_plan(spark, monkeypatch):
    """The driver keeps a plan's description several times; the map's size must not be in it."""
    rows = [(i, f"ordinary words about nothing number{i} from somewhere") for i in range(60)]
    rows += [(400 + i, f"{n} memo of Quillon via q@mail.example.com") for i, n in enumerate("abcd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    longest = lambda df: max(map(len, str(df._jdf.queryExecution()).splitlines()))
    seen, write = [], privacy.materialise
    monkeypatch.setattr(privacy, "materialise", lambda df: seen.append(longest(df)) or write(df))
    found = privacy.entities(docs)
    terms = privacy.with_terms(docs, found)
    assert len(seen) == 5 and terms.count() == 4
    assert max(longest(terms), *seen) < privacy.MAP_BITS // 8


def test_terms_on_the_map(spark):
    """Rows of a term on the map stay as often as they are there; the map has 64 bits to a row."""
    names = spark.createDataFrame([(f"name{i}",) for i in range(5000)], "term string")
    marks = privacy._marked(names.union(names))
    bits = names.select(privacy._slot().alias("slot")).distinct()
    assert marks.agg(F.sum(F.bit_count("bits"))).first()[0] == bits.count()
    assert marks.count() == bits.select(F.expr("slot div 64")).distinct().count()
    others = spark.createDataFrame([(f"other{i}",) for i in range(5000)], "term string")
    rows = names.union(names).union(others).withColumn("n", F.lit(1))
    got = privacy._on_map(rows, marks)
    want = rows.withColumn("slot", privacy._slot()).join(bits, "slot", "left_semi").select("term", "n")
    assert got.columns == ["term", "n"] and got.count() >= 10000
    assert sorted(got.collect()) == sorted(want.collect())
    assert privacy._on_map(rows, marks.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_spans_against_brute_force(spark, seed):
    """Spans apart from others, and replaced spans, overlapping and nested ones too."""
    rng = random.Random(seed)
    rows = []
    for number in range(60):
        text = "".join(rng.choice("ab é😀\n") for _ in range(rng.choice((0, 1, 5, 900, 5000))))

        def some(n, text=text):
            starts = sorted(rng.randrange(len(text)) for _ in range(n)) if text else []
            return [("k", a, min(len(text), a + rng.randrange(1, 12)), "v") for a in starts]

        mine = [s for i, s in enumerate(some(rng.choice((0, 1, 40)))) if i % 2 == 0]
        rows.append((number, text, mine, some(rng.choice((0, 1, 30)))))
    span = "array<struct<kind:string,start:bigint,stop:bigint,value:string>>"
    df = spark.createDataFrame(rows, f"id int, text string, mine {span}, others {span}")
    marks = F.array_sort(
        F.transform("others", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit("[X]").alias("mark")))
    )
    got = df.select(
        "id", spans.apart(F.col("mine"), F.col("others")).alias("apart"), spans.replaced("text", marks).alias("new")
    ).collect()
    for row in got:
        _, text, mine, others = rows[row["id"]]
        free = [s for s in mine if all(o[1] >= s[2] or o[2] <= s[1] for o in others)]
        assert sorted(map(tuple, row["apart"])) == sorted(free)
        new, done = "", 0
        for _, a, b, _ in sorted(others, key=lambda o: (o[1], o[2])):
            if a >= done:
                new += text[done:a] + "[X]"
            done = max(done, b)
        assert row["new"] == new + text[done:]


def test_many_matches_in_one_text(spark):
    n = 30_000
    texts = [" ".join(f"user{i}@host{i % 97}.example.com" for i in range(n)),
             " ".join(f"password=abcdefgh{i:06d}" for i in range(n))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in privacy.find_private(docs).collect()}
    assert found[0]["base_sha256"] == brute.digest(brute.private(texts[0])[1]) and found[0]["n_email"] == n
    held = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
    assert held[1]["base_sha256"] == brute.digest(brute.secrets(texts[1])[1]) and held[1]["n_assign"] == n
    assert {r["doc_id"]: r["text"] for r in privacy.redact(docs).collect()}[0] == " ".join(["[EMAIL]"] * n)
