"""Operators on documents: edge rows, empty tables, brute force."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rentlens.llm import decontaminate, fuzzy_lines, language, mixing, near_dups, quality, repeats, tokens
from rentlens.llm.queries import vocabulary

from conftest import BASE, PASSAGE, edge_rows

TEXTS = {r[0]: r[1] or "" for r in edge_rows() if r[0] is not None}


def by_id(frame) -> dict:
    return {r["doc_id"]: r for r in frame.collect()}


def test_repeats_match_brute_force(docs, nothing):
    rows = repeats.repeats_removed(docs)
    assert rows.count() == len(edge_rows()) and repeats.repeats_removed(nothing).count() == 0
    found, seen = by_id(rows), {}
    for doc in sorted(TEXTS):
        data = TEXTS[doc].encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if seen.setdefault(data[k : k + 50], doc) < doc:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        row = found[doc]
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert found[None].n_removed == 0


def test_large_anchor_groups_match_brute_force_in_bounded_indexes(monkeypatch):
    """A common phrase in unlike and partly equal surroundings, all under one anchor."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(repeats, "INDEX_BYTES", 4000)
    sizes, plain = [], repeats.indexed
    monkeypatch.setattr(repeats, "indexed", lambda block: sizes.append(sum(len(x[0]) for x in block)) or plain(block))
    ends = [bytes(rng.integers(97, 123, 40).astype(np.uint8)) for _ in range(12)]
    texts = [ends[rng.integers(12)][: rng.integers(20, 40)] + b" " * 16 + ends[rng.integers(12)][: rng.integers(20, 40)] for _ in range(400)]
    found, seen, first = set(), {}, defaultdict(list)
    anchor = int(repeats.mix(np.diff(repeats.prefix_sums(np.full(16, 32, np.uint8))[[0, 16]]))[0] >> np.uint64(32))
    for doc, text in enumerate(texts):
        first[anchor, text].append((doc, 0))
        for k in range(len(text) - 49):
            if seen.setdefault(text[k : k + 50], doc) < doc:
                found |= {(doc, i) for i in range(k, k + 50)}
    assert sum(map(len, {t for _, t in first})) > 16000
    assert {(d, i) for d, a, b in repeats.settled(dict(first)) for i in range(a, b)} == found
    assert max(sizes) <= 2 * 4000


def test_near_duplicates(docs, nothing):
    found = near_dups.duplicates(docs)
    rows = found.collect()
    assert len(rows) == len(edge_rows()) and near_dups.duplicates(nothing).count() == 0
    groups = {r.doc_id: r.group_id for r in rows if r.doc_id is not None}
    assert groups[1] == groups[2] == groups[3] == 1 and groups[10] == groups[11] == 10
    assert groups[4] == groups[5] == 4 and groups[12] == 12
    kept = near_dups.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 6, 7, 8, 9, 10, 12, 13} and not {2, 3, 11} & {r.doc_id for r in kept.collect()}


def test_texts_are_shuffled_for_pairs_only(spark, tmp_path):
    """Blocks meet the counts in their buckets: the one exchange of a meeting is that of the counts."""
    docs = spark.createDataFrame([(k, f"a text {k}", "x", k) for k in range(50)], "doc_id long, text string, texts string, source long")
    blocks = near_dups.Blocks(docs, str(tmp_path / "near"))
    wanted = spark.createDataFrame([(r.source, k, k, b"") for r in blocks.frame().select("source").collect() for k in range(2)], "source long, row int, id long, found binary")
    met = blocks.met(wanted, near_dups.take_texts, "id long, text string, found binary", ["texts"])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and met.count() == wanted.count()
    blocks.remove()
    assert not (tmp_path / "near" / "blocks").exists()


def test_equal_ids_with_unlike_texts(spark):
    """Each text is judged for itself: the unlike text of an id does not go with its near copy."""
    other = " ".join(f"o{k}" for k in range(80))
    rows = [(1, BASE), (2, BASE + " end"), (2, other), (3, other), (None, BASE), (None, "x"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.class_id, r.group_id, r.kept) for r in near_dups.duplicates(docs).collect()}
    assert found == {(1, 1, 1, True), (2, 2, 1, False), (2, 2, 2, True), (3, 2, 2, False), (None, 1, 1, False), (None, None, None, True), (4, 4, 4, True)}
    kept = {tuple(r) for r in near_dups.deduplicated(docs).collect()}
    assert kept == {(1, BASE), (2, other), (None, "x"), (4, None)}


def test_variants_of_one_text_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 5000, 150)]
    texts = []
    for k in range(90):
        words = list(base if k % 3 or not texts else texts[-1].split())
        for at in rng.integers(0, len(words), k % 3 * 2 + 1):
            words[at] = f"x{rng.integers(0, 1 << 40)}"
        texts.append(" ".join(words))
    grams = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)]
    idf = Counter(g for x in grams for g in x)
    idf = {g: math.log(1 + len(texts) / n) for g, n in idf.items()}
    total = [sum(n * idf[g] for g, n in x.items()) for x in grams]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            common = sum(min(n, grams[b][g]) * idf[g] for g, n in grams[a].items())
            if common >= 0.8 * (total[a] + total[b] - common) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if x == high else x for x in group]
    found = by_id(near_dups.duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert 10 < len(set(group)) < 80
    assert [found[k].group_id for k in range(len(texts))] == group


def test_near_copies_of_a_large_group_are_found(spark):
    """Neither equal nor near copies of a text make what they have in common weigh less than what each has alone."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in rng.integers(0, 1 << 40, 200)]
    texts = [" ".join(base)] * 60
    for k in range(8):
        words = list(base)
        for at in range(20 + k, 200, 45):
            words[at] = f"x{rng.integers(0, 1 << 40)}"
        texts.append(" ".join(words))  # 176 of 216 shingles in common with base
    texts += [f"a text of its own {k}" for k in range(1200)]
    found = by_id(near_dups.duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [found[k].group_id for k in range(68)] == [0] * 68
    assert all(found[k].group_id == k for k in range(68, len(texts)))


def test_document_frequencies_are_exact():
    """Two hashes that end in the same 20 bits, in different blocks."""
    a, b = np.uint64(5), np.uint64(5 + (1 << 40))
    rows = [(0, 1, [a, b], [3, 1]), (0, 2, [a], [400])]
    cells = [(part, source, np.array(h, np.uint64).tobytes(), near_dups.packed(near_dups.narrow(np.array(n)))) for part, source, h, n in rows]
    table = pa.table(dict(zip(("part", "source", "hashes", "counts"), map(list, zip(*cells, strict=True)), strict=True)))
    found = near_dups.frequencies(table).column("found").to_pylist()
    assert [near_dups.widened(near_dups.unpacked(x), n).tolist() for x, n in zip(found, (2, 1), strict=True)] == [[403, 1], [403]]


def test_consistent_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    own = np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    weights = rng.uniform(0.5, 3, 400).astype(np.float32)
    share, n = 0, 200
    for k in range(n):
        moved = own + np.uint64(k * 7919)
        a = near_dups.signatures(moved, weights, np.array([0, 400]))
        b = near_dups.signatures(moved[:320], weights[:320], np.array([0, 320]))
        share += (a == b).mean() / n
    assert share == pytest.approx(weights[:320].sum() / weights.sum(), abs=0.03)


def test_lines_match_brute_force(docs, nothing, spark):
    line = "the same line of a certain length, with a number 12345 in it and some more words behind it, so it is long"
    rows = [(1, f"{line}\nshort\n\n{line}"), (2, line.replace("12345", "12346") + "\nshort"), (3, None), (4, "a line\n" + line), (None, line)]
    found = by_id(fuzzy_lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found[1].removed_lines == [3] and found[2].removed_lines == [0, 1] and found[4].removed_lines == [1]
    assert found[3].n_lines == 1 and found[None].n_removed == 0
    assert fuzzy_lines.line_report(docs).count() == len(edge_rows()) and fuzzy_lines.line_report(nothing).count() == 0
    texts = by_id(fuzzy_lines.without_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert texts[1].text == f"{line}\nshort\n" and texts[4].text == "a line"


def removed_by_brute_force(lines: list[str]) -> list[int]:
    sets = [fuzzy_lines.shingle_set(x) for x in lines]
    group = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if x == high else x for x in group]
    return [k for k, g in enumerate(group) if g != k]


def test_one_edit_in_lines_of_any_length_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    lines = []
    for size in (30, 38, 39, 50, 80, 150):
        for k in range(8):
            line = "".join(map(chr, rng.permutation(np.arange(0x4E00, 0x4E00 + 3000))[:size]))
            at = 1 if k == 0 else size // 2 + k - 4
            lines += [line, line[:at] + "#" + line[at + 1 :]]
    found = by_id(fuzzy_lines.line_report(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")))[1].removed_lines
    assert found == removed_by_brute_force(lines)
    assert {len(lines[k]) for k in found} >= {39, 50, 80, 150} and sum(len(lines[k]) == 50 for k in found) == 8


def test_periodic_lines_match_brute_force(spark):
    marks = ("-", "=", "|---", ". ", "-=~", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, range(0x4E00, 0x4E00 + 70))))
    lines = [(m * size)[:size] for k, m in enumerate(marks) for size in ((40, 70, 100, 3000) if k % 2 else (40, 100, 3000))]
    found = by_id(fuzzy_lines.line_report(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")))[1].removed_lines
    assert found == removed_by_brute_force(lines) and {1, 2, 4, 5, 6, 8, 9} <= set(found)


def test_sketches_never_rule_out_a_link():
    """Lines of similarity 0.8 and more, in characters that repeat; and unlike lines, which are ruled out."""
    random = np.random.default_rng(9)
    lines = []
    for size in (6, 30, 60, 200, 900):
        for _ in range(30):
            line = "".join(chr(97 + int(k)) for k in random.integers(0, 5 if size < 100 else 26, size))
            at = int(random.integers(0, size))
            lines += [line, line[:at] + "#" + line[at + 1 :], line[at:] + line[:at], line + line[: size // 8]]
    data, offsets = fuzzy_lines.texts(pa.array(["\n".join(lines)]))
    codes, starts, ends, *_ = fuzzy_lines.lines_of(data, offsets)
    own, n = fuzzy_lines.shingles(fuzzy_lines.code_sums(codes), starts, ends)
    drawn = np.unpackbits(fuzzy_lines.sketches(own, n).view(np.uint8), axis=1)
    sets = [fuzzy_lines.shingle_set(x) for x in lines]
    linked, ruled_out, unlike = 0, 0, 0
    for a in range(0, len(lines), 4):
        for b in range(a + 1, min(a + 9, len(lines))):
            possible = 9 * int((drawn[a] != drawn[b]).sum()) <= int(n[a] + n[b])
            similarity = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            assert possible or similarity < fuzzy_lines.SIMILARITY
            linked, unlike = linked + (similarity >= 0.8), unlike + (similarity < 0.3)
            ruled_out += not possible and similarity < 0.3
    assert linked > 50 and ruled_out > 0.7 * unlike


def line_variants(random: np.random.Generator) -> list[str]:
    """Unlike lines of many lengths, two near copies of each, and many near copies of one."""
    lines = []
    for size in (60, 95, 215, 300, 480, 1010, 2200):
        for k in range(6):
            line = "".join(map(chr, random.integers(97, 123, size + 4 * k)))
            lines += [line, line[: size // 2] + "#" + line[size // 2 + 1 :], line + line[3 : size // 12]]
    line = "".join(map(chr, random.integers(97, 123, 216)))
    return lines + [line[: 2 * k] + "#" + line[2 * k + 1 :] for k in range(70)]


def test_line_members_are_small_and_pairs_lose_no_link():
    """The rows dealt by bucket take less than three times the text, and links that share a bucket are pairs or left to rounds."""
    lines = line_variants(np.random.default_rng(3))
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["\n".join(lines)])], ["doc_id", "text"])
    members = pa.Table.from_batches(fuzzy_lines.signer(iter([batch])))
    assert members.nbytes < 3 * len("\n".join(lines))
    members = members.sort_by([(x, "ascending") for x in ("bucket", "size", "id")]).combine_chunks()
    found = pa.Table.from_batches(fuzzy_lines.pairer(iter(members.to_batches(100))))
    pairs = {(x["id"], x["other"]) for x in found.to_pylist() if x["other"] is not None}
    parts: dict[int, dict[int, list[int]]] = {}
    for x in found.to_pylist():
        if x["other"] is None:
            parts.setdefault(x["bucket"], {})[x["id"]] = x
    ids = next(fuzzy_lines.numberer(iter([batch]))).column("id").to_pylist()
    buckets: dict[int, set[int]] = {}
    for x in members.select(["bucket", "id"]).to_pylist():
        buckets.setdefault(x["id"], set()).add(x["bucket"])
    rounds = set()
    for rows in parts.values():
        for a, x in rows.items():
            for b, y in rows.items():
                differ = sum(((x[s] ^ y[s]) & (2**64 - 1)).bit_count() for s in fuzzy_lines.SKETCH)
                if a < b and 9 * differ <= x["size"] + y["size"]:
                    rounds.add((a, b))
    sets = [fuzzy_lines.shingle_set(x) for x in lines]
    links = 0
    for a in range(len(lines)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and buckets[ids[a]] & buckets[ids[b]]:
                links += 1
                assert tuple(sorted((ids[a], ids[b]))) in pairs | rounds
    assert links > 500 and rounds and len(pairs) < 2 * links


def test_lines_of_crowded_buckets_match_brute_force(spark):
    lines = line_variants(np.random.default_rng(4))
    found = by_id(fuzzy_lines.line_report(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")))[1].removed_lines
    assert found == removed_by_brute_force(lines)


def test_lines_of_similarity_share_a_scheme():
    assert fuzzy_lines.SHORT <= fuzzy_lines.SIMILARITY * (fuzzy_lines.LONG + 1)
    lines = ["-" * 40, "-" * 100, "ab" * 300, "".join(map(chr, range(0x4E00, 0x4E00 + 200)))]
    codes = np.array([ord(c) for c in "".join(lines)], np.uint32)
    ends = np.cumsum([len(x) for x in lines])
    counts = fuzzy_lines.n_distinct(*fuzzy_lines.shingles(fuzzy_lines.code_sums(codes), ends - [len(x) for x in lines], ends))
    assert counts.tolist() == [37, 1, 2, 197]


def test_contamination(docs, nothing, spark):
    items = spark.createDataFrame([(1, PASSAGE), (2, "Grüße AUS"), (3, None), (None, "a text without id"), (2, "zzz")], "item_id long, text string")
    found = by_id(decontaminate.contamination(docs, items))
    assert found[8].n_items == 1 and found[8].n_hit == len(PASSAGE.replace(",", "").split())
    assert found[7].n_hit == 2 and found[7].items_sha256 == hashlib.sha256(b"2").hexdigest()
    assert found[None].n_items == 0 and found[4].n_words == 0 and not found[10].contaminated
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns and not {7, 8, 9} & {r.doc_id for r in clean.collect()}
    assert by_id(decontaminate.clean_spans(docs, items))[8].text == "start  stop"
    assert decontaminate.contamination(nothing, items).count() == 0
    assert decontaminate.clean_documents(docs, items.limit(0)).count() == len(edge_rows())


def test_benchmark_blocks_agree(docs, spark):
    items = spark.createDataFrame([(k, f"Grüße aus {k}") for k in range(20)] + [(99, PASSAGE), (98, "zweite Zeile")], "item_id long, text string")
    one = decontaminate.marked(docs, items).select("row.c0", "mask", "items", "hit")
    many = decontaminate.marked(docs, items, block_bytes=100).select("row.c0", "mask", "items", "hit")
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_language(docs, nothing, spark):
    found = language.identify(docs).collect()
    assert len(found) == len(edge_rows())
    assert {r.lang_pred for r in found if r.doc_id in (4, 5, 6)} == {"und"} and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert language.identify(nothing).count() == 0
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and not {4, 5, 6} & {r.doc_id for r in kept.collect()}


def test_language_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(documents).where("held_out").join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 200 and sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)


def plain_grams(text: str | None) -> list[str]:
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    letters = " ".join(letters.split())
    padded = f" {letters} " if letters else ""
    return [padded[k : k + size] for size in (1, 2, 3) for k in range(len(padded) - size + 1)]


def plain_slot(gram: str) -> int:
    value = 0
    for c in gram:
        value = (value * 0x01000193 + ord(c)) & 0xFFFFFFFF
    return (((value * 0x9E3779B1) & 0xFFFFFFFF) ^ (len(gram) * 0x5BD1E995 & 0xFFFFFFFF)) >> 16


@pytest.mark.parametrize("at_once", [256, 2])
def test_language_is_bayes_with_dictionaries(spark, at_once):
    """Five languages, in one block or three; a text without letters, one of numerals, one without n-grams known."""
    rows = [(k, " ".join(f"{lang}{(k * 7 + i * i) % 13}{'aeiou'[(k + i) % 5]}x" for i in range(12)), lang) for lang in ("de", "en", "fr", "xx", "yy") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, totals = defaultdict(lambda: defaultdict(int)), {}
    for _, text, lang in rows:
        for gram in plain_grams(text):
            counts[lang][plain_slot(gram)] += 1
    for lang, c in counts.items():
        totals[lang] = sum(c.values()) + language.SMOOTHING * language.BUCKETS
    models = language.fit(docs, at_once)
    assert [n for m in models for n in m.names] == sorted(counts)
    asked = [r[1] for r in rows] + ["dex enx frx", "ß", "½ Ⅷ ² 12 _", None, "", "de" * 400]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "doc_id long, text string")
    found = {r.c0: (r.lang_pred, r.score) for r in language.predicted(frame, models, ["doc_id"]).select("row.c0", "lang_pred", "score").collect()}
    for k, text in enumerate(asked):
        grams = plain_grams(text)
        if not grams:
            assert found[k] == ("und", 0.0)
            continue
        logs = {lang: sum(math.log((c[plain_slot(g)] + language.SMOOTHING) / totals[lang]) for g in grams) for lang, c in counts.items()}
        best = max(sorted(logs), key=lambda x: logs[x])
        tempered = min(1.0, language.EVIDENCE * 3 / len(grams))
        assert found[k][0] == best and found[k][1] == pytest.approx(1 / sum(math.exp((x - logs[best]) * tempered) for x in logs.values()), abs=1e-4)


def test_pieces_of_a_text_have_its_grams(monkeypatch):
    text = "Σίσυφος, 12 Ärger½straße\t日本𐄇x𝟙 " * 40
    whole = [language.slots(language.normal(text), 1 << 30)]
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(language, "PIECE_CHARS", size)
        cut = list(language.pieces(text))
        assert len(cut) > 4 and np.array_equal(np.sort(np.concatenate(cut)), np.sort(whole[0]))
    assert sorted(whole[0].tolist()) == sorted(map(plain_slot, plain_grams(text)))


def test_quality(docs, nothing):
    found = by_id(quality.judged(docs))
    for doc, text in TEXTS.items():
        words = text.split()
        windows = defaultdict(list)
        for k in range(len(words) - 4):
            windows[tuple(words[k : k + 5])].append(k)
        repeated = {k + i for at in windows.values() if len(at) > 1 for k in at for i in range(5)}
        lines = [x for x in text.split("\n") if x.strip()]
        row = found[doc]
        assert (row.n_words, row.word_chars, row.n_repeat_words) == (len(words), sum(map(len, words)), len(repeated))
        assert row.n_dup_lines == len(lines) - len(set(lines)) and row.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))
    assert quality.judged(nothing).count() == 0


JUNK = ["! " * 60, "a b " * 40, "- item\n" * 60, "x" * 600 + " and some more words that make it ten or so", "12345 67890 " * 30, "SHOUT LOUD " * 30, "so it goes...\n" * 1 + "\n".join(f"line {k}..." for k in range(40)), "?" * 40 + " what is it now", "{} " * 50]


def test_cascade_order_leaves_the_verdict(spark):
    texts = [(k, t) for k, t in enumerate(JUNK + [BASE, "plain words about nothing much, " * 3])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    frame = docs.withColumn("words", quality.split_words(F.col("text")))
    for rules in (quality.RULES, quality.RULES[::-1]):
        found = {r.doc_id: r.name for r in frame.select("doc_id", quality.rejected_by(F.col("text"), F.col("words"), rules).alias("name")).collect()}
        assert all(found[k] is None for k, kept in one.items() if kept)
        assert all(found[k] for k in range(len(JUNK)))


def test_measured_order_beats_the_reverse(spark):
    """Cheap rules that reject much go first, by what is left; the order costs less than others, measured and counted."""
    rules = {n: quality.Rule(n, lambda t, w: F.lit(True)) for n in "abcd"}
    cost = {"a": 1.0, "b": 0.1, "c": 0.1, "d": 5.0}
    fails = [{"a", "b"}] * 50 + [{"c"}] * 10 + [{"a"}] * 5 + [{"d"}] * 30 + [set()] * 100
    best = quality.ordered(list(rules.values()), cost, fails)
    assert [r.name for r in best] == ["b", "c", "d", "a"]
    assert quality.expected_cost(best, cost, fails) < quality.expected_cost(best[::-1], cost, fails)
    docs = spark.createDataFrame([(k, JUNK[k % len(JUNK)] if k % 3 else BASE) for k in range(600)], "doc_id long, text string").repartition(8)
    sample = quality.sampled(docs, 300)
    assert sample.select(F.spark_partition_id()).distinct().count() == 8 and 200 < sample.count() < 400
    cost, fails = quality.measured(sample, quality.RULES)
    best = quality.ordered(quality.RULES, cost, fails)
    assert any(fails) and quality.expected_cost(best, cost, fails) < quality.expected_cost(best[::-1], cost, fails)
    dear = [quality.Rule("dear", lambda t, w: quality.repeated_words(w) >= 0), quality.Rule("cheap", lambda t, w: t != "z")]
    cost, _ = quality.measured(sample, dear)
    assert cost["dear"] > cost["cheap"]


def test_mixing(docs, nothing):
    found = mixing.mixture(docs).collect()
    assert len(found) == len(edge_rows()) and all(0 < r.prob <= 1 for r in found)
    assert mixing.mixture(nothing).count() == 0 and mixing.sampled(docs).columns == docs.columns
    cells = {("a", "x"): 10.0, ("a", "y"): 30.0, ("b", "x"): 40.0, ("b", "y"): 20.0}
    raked, error = mixing.rake(cells, [{"a": 0.5, "b": 0.5}, {"x": 0.3, "y": 0.7}], 0.5)
    assert mixing.margin_of(raked, 0) == pytest.approx({"a": 25, "b": 25}) and mixing.margin_of(raked, 1) == pytest.approx({"x": 15, "y": 35})
    assert error < 1e-8 and all(0 < raked[k] <= cells[k] for k in cells)


def test_whole_cells_and_targets_that_cannot_hold():
    """A rare value is taken whole, the rest fitted again; what contradicting targets miss is told."""
    cells = {("a", "x"): 900.0, ("a", "y"): 90.0, ("b", "x"): 9.0, ("b", "y"): 1.0, ("c", "z"): 0.0}
    raked, error = mixing.rake(cells, [{"a": 0.5, "b": 0.5}, {"x": 0.9, "y": 0.1}], 0.6)
    assert raked["b", "x"] == 9 and raked["b", "y"] == 1 and error < 1e-8
    assert sum(raked.values()) == pytest.approx(600) and mixing.margin_of(raked, 1) == pytest.approx({"x": 540, "y": 60})
    tied = {("a", "x"): 50.0, ("b", "y"): 50.0}
    _, error = mixing.rake(tied, [{"a": 0.9, "b": 0.1}, {"x": 0.1, "y": 0.9}], 0.5)
    assert error > 0.3
    assert mixing.rake({}, [{}, {}]) == ({}, 0.0)


def test_given_targets_hold_and_draws_come_near(spark):
    """Probabilities times tokens give the margins asked for, by the driver's way and by Spark's."""
    rows = [(k, "w " * (1 + k % 7), "abc"[k % 3], None if k % 5 == 0 else "en") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = spark.createDataFrame([("source", "a", 0.2), ("source", "b", 0.3), ("source", "c", 0.5), ("source", "none", 0.7), ("lang", "en", 0.75), ("lang", None, 0.25)], "dimension string, value string, share double")
    found = {r.doc_id: r for r in mixing.mixture(docs, targets, 0.4).collect()}
    total = sum(r.n_tokens for r in found.values())
    for name, value, want in (("source", "a", 0.2), ("source", "b", 0.3), ("source", "c", 0.5), ("lang", "en", 0.75), ("lang", None, 0.25)):
        own = [r for r in found.values() if r[name] == value]
        assert sum(r.prob * r.n_tokens for r in own) == pytest.approx(0.4 * total * want, rel=1e-6)
        assert sum(r.n_tokens for r in own if r.picked) == pytest.approx(0.4 * total * want, rel=0.12)
    spread = {r.doc_id: r for r in mixing.mixture(docs, targets, 0.4, gathered=1).collect()}
    assert all(spread[k].prob == pytest.approx(r.prob, abs=1e-7) for k, r in found.items())
    assert {r.error for r in spread.values()} == {0.0}


def test_tokens_round_trip(docs, nothing):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(vocabulary())
    found = sorted(tokens.encoded(docs, vocabulary()).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((r[0] for r in edge_rows()), key=lambda x: (x is not None, x))
    start = 0
    for r in found:
        if r.doc_id is not None:
            ids = np.array([*reference.encode(TEXTS[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        assert r.start == start
        start += r.n_tokens
    assert tokens.encoded(nothing, vocabulary()).count() == 0


def test_words_and_whole_texts_encode_alike():
    words, whole = tokens.Encoder(vocabulary()), tokens.Encoder(vocabulary(), by_words=False)
    for text in (BASE, "don't <|endoftext|> STOP<|startoftext|>", "é ́x y\r\n z", "", "\n \n", "日本 語 ͅΣ 'S 's"):
        assert words.encode(text) == whole.encode(text)


def test_tokenizers_that_look_across_blanks_encode_whole_texts():
    crossing = tokens.Encoder(vocabulary("byte_bpe_50k.json"))
    assert tokens.Encoder(vocabulary()).by_words and not crossing.by_words
    assert crossing.encode("a b c") == crossing.ids(["a b c"])[0] != b"".join(crossing.ids(["a", "b", "c"]))


def test_batches_encode_as_texts_do(monkeypatch):
    """Small tables of known words, small pieces, marks within words."""
    whole = tokens.Encoder(vocabulary(), by_words=False)
    asked = [BASE, "", "§ a§b ¶ x", "long " * 50 + BASE, "\n", "é don't", BASE[:90], "new1 new2 new3 a b c d e f g"] * 2
    for name, value in (("CACHE_WORDS", 40), ("WORDS_AT_ONCE", 3), ("PIECE_CHARS", 100)):
        monkeypatch.setattr(tokens, name, value)
    assert list(tokens.Encoder(vocabulary()).encode_batch(asked)) == whole.ids(asked)


def test_repeats_ask_the_table_of_words_once():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    words = tokens.Encoder(vocabulary())
    words.known = Counted(words.known)
    asked = ["a Bc don't x. " * 20, "x. a§b don't " * 20]
    assert list(words.encode_batch(asked)) == words.ids(asked)
    assert 0 < Counted.asked <= 10


def test_random_words_encode_as_texts_do():
    random = np.random.default_rng(11)
    letters = list("abzABZéÉßñÑÞþµÿΣσςİıŁłǅ日語½Ⅷ²19_'.,;:!?%$&#*|-()<>\u0301\u0345\u00ad §¶") + ["'s", "'LL", " ", "\n", "\t", "\r\n", "<|endoftext|>"]
    asked = ["".join(letters[k] for k in random.integers(0, len(letters), n)) for n in random.integers(1, 40, 4000)]
    words, whole = tokens.Encoder(vocabulary()), tokens.Encoder(vocabulary(), by_words=False)
    assert words.folds and words.tails
    assert list(words.encode_batch(asked)) == whole.ids(asked)


def test_any_token_is_addressable(tmp_path):
    ids = np.random.default_rng(3).choice([3, 200, 255, 256, 40000, 70000, 1 << 24], 5000).astype(np.uint32)
    (tmp_path / "x.ids").write_bytes(b"".join(tokens.shard_bytes([7, 9], [2000, 3000], ids)))
    shard = tokens.Shard(str(tmp_path / "x.ids"))
    assert [shard.token(k) for k in range(0, 5000, 37)] == ids[::37].tolist()
    assert (shard.tokens(511, 1800) == ids[511:1800]).all() and len(shard.tokens(5, 5)) == 0
    assert [(d, s, len(x)) for d, s, x in shard.documents()] == [(7, 0, 2000), (9, 2000, 3000)]


def test_matching_statistics_match_brute_force():
    from rentlens.llm.run_index import RunIndex

    rng = np.random.default_rng(5)
    strings = [bytes(rng.integers(97, 100, rng.integers(5, 40)).astype(np.uint8)) for _ in range(60)]
    queries = [bytes(rng.integers(97, 101, rng.integers(1, 40)).astype(np.uint8)) for _ in range(60)] + strings[:5]
    first, found, owner = RunIndex(strings, np.arange(60), 6).matches(queries)
    for q, at in zip(queries, first.tolist()):
        for k in range(len(q)):
            best = max(n for n in range(len(q) - k + 1) if n == 0 or any(q[k : k + n] in s for s in strings))
            assert found[at + k] == best
            if best >= 6:
                assert owner[at + k] == min(i for i, s in enumerate(strings) if q[k : k + 6] in s)


def test_texts_of_sliced_columns():
    column = pa.array(["a", None, "", "bé", "c"]).slice(1, 3)
    from rentlens.llm.bytewords import texts

    data, offsets = texts(column)
    assert data.tobytes() == "bé".encode() and offsets.tolist() == [0, 0, 0, 3]


def test_texts_of_a_batch_share_the_lookup_of_their_words():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    words = tokens.Encoder(vocabulary())
    words.known = Counted(words.known)
    asked = ["a Bc don't x.\n" * 50_000, "", "x. don't " * 80_000, " a  Bc" * 120_000]
    found = list(words.encode_batch(asked))
    assert 0 < Counted.asked <= 10
    assert found == tokens.Encoder(vocabulary(), by_words=False).ids(asked)
