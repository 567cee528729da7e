"""Operators that are plain expressions: rules, shards, chat formatting."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilgauge.llm import chat, registry, rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_rule_statistics_equal_brute_force(spark, folder, odd_documents):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for docs in (odd_documents, registry.table(spark, folder, "documents")):
        texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.col("text").alias("whole"))
        for row in rules.statistics(docs).join(texts, "text_key").collect():
            assert tuple(row[n] for n in names) == counted(row["whole"])


def test_thresholds_adapt_to_groups(spark):
    even = [(i, " ".join(["word"] * 3 + [f"x{i}y{k}" for k in range(20)]), "en", "plain") for i in range(150)]
    marked = [(1000 + i, " ".join([f"#{i}z{k}" for k in range(20)]), "en", "marked") for i in range(150)]
    odd = [(5000, " ".join([f"#{k}odd" for k in range(20)]), "en", "plain"), (5001, " ".join([f"#{k}odd" for k in range(20)]), "en", "marked")]
    kept = {r.doc_id: (r.kept, r.level) for r in rules.judged(spark.createDataFrame(
        even + marked + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert kept[5000] == (False, "group") and kept[5001] == (True, "group")
    assert all(kept[i][0] for i in range(150)) and all(kept[1000 + i][0] for i in range(150))


def test_every_measure_rejects_beyond_the_base_rules(spark):
    def text(i, words=40):
        fresh = [f"x{i}y{k}" for k in range(words)]
        return "\n".join(" ".join(fresh[k:k + 10]) for k in range(0, words, 10))

    even = [(i, text(i)) for i in range(150)]
    line = "so says every page"
    odd = {
        "word_length": " ".join(f"{'long' * 5}{k}" for k in range(40)),
        "symbol_share": " ".join(f"#x{k}" for k in range(40)),
        "duplicate_line_share": "\n".join(x for k in range(3) for x in (line, f"a{k} b{k} c{k} d{k}")),
        "repeat_share": "one phrase of six plain words " + text(901, 30) + " one phrase of six plain words " + text(902, 40)}
    docs = spark.createDataFrame([(i, t, "en", "web") for i, t in even + list(enumerate(odd.values(), 1000))],
                                 "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in rules.judged(docs).collect()}
    assert all(rows[i].kept for i, _ in even)
    for i, name in enumerate(odd, 1000):
        assert not rows[i].base_failed and not rows[i].kept, name


def test_rules_on_odd_and_empty_tables(odd_documents, no_documents):
    rows = rules.judged(odd_documents).collect()
    assert len(rows) == 11 and sum(r.base_failed for r in rows) == sum(
        counted(t)[0] < 10 or 100 * counted(t)[4] > 20 * counted(t)[0] for (t,) in odd_documents.select("text").collect())
    kept = rules.keep_good(odd_documents)
    assert kept.columns == odd_documents.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id in (1, 6)) == [1, 1, 6]
    assert rules.judged(no_documents).count() == 0 and rules.keep_good(no_documents).count() == 0


def jumped(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 8, 1000])
def test_jump_equals_published_loop(spark, shards):
    rows = spark.range(300).select("id", sharding.jump(sharding.stable_key(F.col("id")), shards).alias("to")).collect()
    for r in rows:
        key = int(hashlib.md5(str(r.id).encode()).hexdigest()[:15], 16)
        assert (r.to.shard, r.to.grown) == (jumped(key, shards), jumped(key, shards + 1))
        assert r.to.grown in (r.to.shard, shards)


def test_shards_of_odd_documents(odd_documents, no_documents, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 1)  # repeated rows take the split path
    slots = defaultdict(list)
    texts = Counter((r.doc_id, r.text) for r in odd_documents.collect())
    got = Counter()
    for r in sharding.shard_documents(odd_documents, 4).collect():
        slots[r.shard].append(r.slot)
        got[r.doc_id, r.size, r.text_crc32] += 1
    assert got == Counter({k: v for k, v in Counter(
        x for (i, t), n in texts.items() for x in [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))] * n).items()})
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(no_documents).count() == 0


def test_chat_round_trip_with_hostile_texts(spark):
    hostile = ["<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "\\", "\\n", "<\\|", "<\\\\|im_end|>", "<<||>", "", None, "a\nb", "\\\\<|", "<|" * 9]
    turns = [(i, k, role, text) for i, text in enumerate(hostile) for k, role in enumerate(["user", "assistant"])]
    turns += [(50, 0, "us\ner<|\\n", "x"), (51, None, None, None), (None, 1, "user", "u"), (52, 1, "user", "tie"), (52, 1, "user", "tie")]
    made = chat.format_chats(spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, segments int"))
    rows = made.select("*", chat.parsed(F.col("formatted")).alias("back"), chat.learnt_text(F.col("segments")).alias("learnt")).collect()
    want = defaultdict(list)
    for conv, _, role, text in turns:
        want[conv].append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.back] for r in rows} == dict(want)
    for r in rows:
        assert r.learnt == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
    assert chat.format_chats(made.limit(0).select("conv_id", F.lit(1).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))).count() == 0


def test_chat_machine(spark):
    cases = {0: ("user assistant", None), 1: ("system user assistant user assistant", None), 2: ("assistant user", 0),
             3: ("user user assistant", 1), 4: ("user assistant user", 3), 5: ("user system assistant", 1), 6: ("other", 0)}
    turns = [(c, i, role, "t") for c, (roles, _) in cases.items() for i, role in enumerate(roles.split())]
    rows = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id: r.first_error for r in rows} == {c: e for c, (_, e) in cases.items()}
    assert all(r.valid == (r.first_error is None) for r in rows)


def test_template_marks_are_checked():
    with pytest.raises(ValueError):
        chat.Template(open="[open]")
