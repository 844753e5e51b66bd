"""Licence scans, chat formatting, mixing and sharding, and their SQL."""

import hashlib
import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkquill.llm import chat, licenses, mixing, queries, sharding
from tests.llm.helpers import WORD, docs
from tests.test_queries import connect, plain

# ---------------------------------------------------------------- against SQL


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = connect(sf_dir).sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert plain(df.select(*columns).collect()) == plain(tuple(row[i] for i in at) for row in found.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


# ---------------------------------------------------------------- licences


def scanned(spark, rows):
    table = spark.createDataFrame([(k, p, t, "x", 1) for k, (p, t) in enumerate(rows)], "doc_id long, path string, text string, dir string, n_words int")
    return [tuple(r)[2:4] for r in sorted(licenses.scan_licenses(table).collect(), key=lambda r: r.doc_id)]


def test_notices_and_inheritance(spark):
    body = "int main\n" + "lorem ipsum\n" * 50
    rows = [
        ("a/LICENSE", "Released under the MIT License.\n" + body),
        ("a/b/x.c", body),
        ("a/b/c/LICENSE.txt", "Licensed under the Apache License,\nVersion 2.0"),
        ("a/b/c/d/y.c", body),
        ("a/b/c/d/z.c", "// Licensed under CC BY-NC 4.0.\n" + body),
        ("q/w.c", body),
        ("top.c", None),
        (None, "This work is licensed under the GNU General Public License, version 3."),
        ("ab/x.c", ""),
        ("a/b/NOTICE", body),
    ]
    assert scanned(spark, rows) == [("mit", "own"), ("mit", "inherited"), ("apache-2.0", "own"), ("apache-2.0", "inherited"), ("cc-by-nc-4.0", "own"), (None, "none"), (None, "none"), ("gpl-3.0", "own"), (None, "none"), ("mit", "inherited")]


def test_licences_of_an_empty_table_and_a_long_text(spark):
    assert scanned(spark, []) == []
    assert scanned(spark, [("a/x", "word " * 300_000 + "\nReleased under the MIT License.\n" + "word\n" * 50_000)]) == [("mit", "own")]


MIT = """Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""


def test_notices_within_other_text(spark):
    prose = " ".join(f"wort{k}" for k in range(300))
    beside = "1 mit use work " + prose
    notices = {name: text for name, text in licenses.TEMPLATES[::-1] if not text.startswith("SPDX")}
    rows = [
        ("a", f"{beside}\nLicensed under CC BY-NC 4.0.\n{beside}"),
        ("b", f"{prose} Released under the MIT License. {prose}"),
        ("c", f"{prose} Licensed under the Apache\n\n # License, Version 2.0 {prose}"),
        ("d", MIT + prose),
        ("e", f"{prose} released under license, {prose} public general, {prose} version 3"),
        *((name, f"{beside} {text}\n{beside}") for name, text in notices.items()),
    ]
    found = [license for license, _ in scanned(spark, rows)]
    assert found == ["cc-by-nc-4.0", "mit", "apache-2.0", "mit", None, *notices]


HEADER = """This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by
the Free Software Foundation{mark} either version {version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details.
"""


def test_headers_tell_versions_apart(spark):
    kinds = [("gpl-2.0", "General Public License", "2"), ("gpl-3.0", "General Public License", "3"), ("lgpl-2.1", "Lesser General Public License", "2.1"), ("lgpl-3.0", "Lesser General Public License", "3"), ("agpl-3.0", "Affero General Public License", "3")]
    rows = [(f"{n}.c", "\n".join(f" * {line}" for line in HEADER.format(what=what, mark=mark, kind=kind, version=version).split("\n")) + "\nint main() {}\n" * 30) for n, kind, version in kinds for what in ("program", "library") for mark in (":", ";", ",")]
    assert [license for license, _ in scanned(spark, rows)] == [n for n, *_ in kinds for _ in range(6)]


def test_spdx_lines(spark):
    prose = " ".join(f"wort{k}" for k in range(200))
    names = sorted({name for name, _ in licenses.TEMPLATES})
    rows = [(f"{n}.c", f"// SPDX-License-Identifier: {n.upper()}\n{prose}") for n in names] + [("or.c", f"# SPDX-License-Identifier: GPL-2.0-or-later\n{prose}"), ("no.c", f"# SPDX-License-Identifier: Unknown-9.9\n{prose}")]
    assert [license for license, _ in scanned(spark, rows)] == [*names, "gpl-2.0", None]


def test_rows_that_repeat_or_have_no_id(spark):
    notice, schema = "Released under the MIT License.", "doc_id long, path string, text string, row long, term string, idf double"
    rows = [(1, "a/LICENSE", notice), (1, "b/x.c", "int x"), (1, "b/LICENSE", "Licensed under CC BY 4.0"), (None, "a/y.c", "int y"), (None, "c/z.c", notice + " int z " * 60), (1, "a/LICENSE", notice)]
    table = spark.createDataFrame([(*r, 7, "t", 0.5) for r in rows], schema)
    found = sorted((repr(r.doc_id), r.path, r.license, r.origin) for r in licenses.scan_licenses(table).collect())
    assert found == sorted([("1", "a/LICENSE", "mit", "own"), ("1", "b/x.c", "cc-by-4.0", "inherited"), ("1", "b/LICENSE", "cc-by-4.0", "own"), ("None", "a/y.c", "mit", "inherited"), ("None", "c/z.c", "mit", "own"), ("1", "a/LICENSE", "mit", "own")])


def test_frequent_words_weigh_little(spark):
    rows = [(f"{k}.txt", f"common words here {k}") for k in range(60)] + [("x.txt", "Released common under common the MIT License"), ("y.txt", "Released rare2 under rare3 the MIT License")]
    table = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    score = {r.path: r.score for r in licenses.scan_licenses(table).collect()}
    assert score["x.txt"] > score["y.txt"] > 0.7


@pytest.mark.parametrize(("name", "license"), [("Apache-2.0", "apache-2.0"), ("GPL-2", "gpl-2.0"), ("GPL-3", "gpl-3.0"), ("LGPL-2.1", "lgpl-2.1"), ("LGPL-3", "lgpl-3.0"), ("MPL-2.0", "mpl-2.0"), ("BSD", "bsd-3-clause")])
def test_whole_licence_files(spark, name, license):
    file = Path("/usr/share/common-licenses", name)
    if not file.exists():
        pytest.skip("this system has no such file")
    assert scanned(spark, [("a/LICENSE", file.read_text()), ("a/b/x.c", "x")]) == [(license, "own"), (license, "inherited")]


BSD = """Copyright (c) {year}, {who}
{title}
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
THIRD = """
3. Neither the name of {who} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
OTHERS = {
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "cc0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\nStatement of Purpose",
    "bsl-1.0": "Boost Software License - Version 1.0 - August 17th, 2003",
}


def test_licences_that_share_sentences_are_told_apart(spark):
    rows, expected = [], []
    for title in ("", "BSD 2-Clause License\n", "All rights reserved.\n"):
        for third, name in (("", "bsd-2-clause"), (THIRD.format(who="the copyright holder"), "bsd-3-clause"), (THIRD.format(who="Some Institute of Technology"), "bsd-3-clause")):
            rows.append((f"{len(rows)}/LICENSE", BSD.format(year=2020, who="Someone", title=title if name[4] == "2" else "", third=third)))
            expected.append((name, "own"))
    for name, text in OTHERS.items():
        rows.append((f"{len(rows)}/LICENSE", f"Copyright (c) 2021 Someone\n\n{text}\n"))
        expected.append((name, "own"))
    rows.append((f"{len(rows)}/LICENSE", MIT))
    rows.append((f"{len(rows)}/x.txt", "This is not released under the MIT License."))
    assert scanned(spark, rows) == [*expected, ("mit", "own"), ("mit", "own")]


# ---------------------------------------------------------------- chat

NASTY = ["", "\\", "\\\\|", "<|end|>", "<\\|end|>", "<<|turn|>", "<", "</s>[INST] ok [/INST]", "[\\INST]", "<<SYS>>x<</SYS>>", "a\n|>", "é😀", "\\<|text|>\\", "[INST", "$1 \\$1"]


def test_escapes_are_reversed(spark):
    rng = random.Random(1)
    texts = NASTY + ["".join(rng.choice(["<", "|", "\\", "turn", "[", "]", "/", "INST", "s>", "text|>", "SYS>>", "x"]) for _ in range(rng.randrange(20))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_digests_of_awkward_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, x int"
    rows = [(k, t, role, text) for k in range(3) for t, (role, text) in enumerate(zip(["system", "user", "assistant", "<|x"] * 4, NASTY, strict=False))]
    rows += [(9, 0, "assistant", None), (9, None, None, "before"), (9, 0, "assistant", "twice"), (9, 0, "assistant", "twice"), (None, 1, "user", "lost"), (10, 1, "user", "x" * 100_000)]
    table = spark.createDataFrame([(*r, "f", 1) for r in rows], schema)
    found = {r.conv_id: r for r in chat.format_digest(table).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        trained = "".join(text for *_, role, text in turns if role == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(trained), hashlib.sha256(trained.encode()).hexdigest())
    assert chat.format_digest(table.limit(0)).count() == 0


def test_spans_are_what_the_mask_marks(spark):
    rows = [(1, k, role, text) for k, (role, text) in enumerate(zip(["user", "assistant"] * 7, NASTY, strict=False))]
    (r,) = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    under = [r.formatted[s.start : s.end] for s in r.loss_spans]
    assert under == [x[0] for x in spark.createDataFrame([(t,) for _, _, role, t in rows if role == "assistant"], "t string").select(chat.escape(F.col("t"))).collect()]
    assert r.loss_mask == [role == "assistant" for _, _, role, _ in rows]


def test_logs_fold_into_messages(spark):
    log = [
        (1, 1, 0, "message", "user", "Hi"), (1, 2, 1, "delta", "assistant", "Hel"), (1, 3, 1, "delta", None, "lo"), (1, 4, 2, "message", "user", "Mor"),
        (1, 5, 2, "delta", None, "e"), (1, 6, 3, "delta", "assistant", "gone"), (1, 7, 3, "regenerate", None, None), (1, 8, 3, "delta", None, "kept"),
        (2, 1, 0, "message", "user", "old"), (2, 2, 1, "message", "assistant", "answer to old"), (2, 3, 0, "edit", None, "new"), (2, 4, 1, "delta", "assistant", "answer"), (2, 5, 1, "delta", None, " to new"),
        (3, 1, 0, None, None, None),
    ]
    found = chat.fold_events(spark.createDataFrame(log, "conv_id long, seq long, turn long, op string, role string, text string")).collect()
    assert sorted(((r.conv_id, r.turn, r.role, r.text) for r in found), key=repr) == [(1, 0, "user", "Hi"), (1, 1, "assistant", "Hello"), (1, 2, "user", "More"), (1, 3, "assistant", "kept"), (2, 0, "user", "new"), (2, 1, "assistant", "answer to new"), (3, 0, None, "")]


# ---------------------------------------------------------------- mixing


def mixture(rows):
    """source -> target, by raising a common level until nothing exceeds three times its size."""
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall((text or "").encode()))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, targets, free = sum(sizes.values()), {}, set(sizes)
    while free:
        level = (total - sum(targets.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 3 * sizes[s]}
        targets |= {s: 3 * sizes[s] if over else level * weights[s] for s in over or free}
        free -= over or free
    return sizes, targets


def test_targets_and_takes(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randrange(0, 60), None, source) for k, source in enumerate(rng.choices(["a", "B", "é", None, "tiny", "z"], [40, 5, 9, 7, 1, 30], k=400))]
    rows += [(1000, None, None, "empty"), (None, "x y", None, "a"), (5, rows[5][1], None, rows[5][3]), (1001, "w " * 50_000, None, "z")]
    sizes, targets = mixture(rows)
    mixed = mixing.mix_sources(docs(spark, rows), bucket_rows=50)
    found = mixed.collect()
    assert len(found) == len(rows)
    for source, target in targets.items():
        own = [r for r in found if r.source == source]
        assert all(abs(r.target - target) < 1e-6 * max(1, target) and r.source_size == sizes[source] for r in own)
        assert sum(r.taken for r in own) == int(target + 0.5)
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.epochs * r.size + r.part for r in found)
    assert sum(r.source_size and r.part not in (0, r.size) for r in found) <= len(sizes)
    again = mixing.mix_sources(docs(spark, rows).repartition(7), bucket_rows=50)
    assert plain(r[1:] for r in mixed.select("text", "doc_id", "taken").collect()) == plain(r[1:] for r in again.select("text", "doc_id", "taken").collect())
    copies = mixing.repeat_rows(mixed, docs(spark, rows).columns)
    assert copies.columns == docs(spark, rows).columns
    assert copies.where("doc_id = 7").count() in {r.epochs + k for r in found if r.doc_id == 7 for k in (0, 1)}


def test_mixing_empty_tables(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix_sources(docs(spark, [(1, None), (2, " ")])).collect()] == [0, 0]


# ---------------------------------------------------------------- sharding


def check_shards(rows, found, shards=8):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=repr) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    loads = [sum(r.size for r in found if r.shard == s) for s in range(shards)]
    for s in range(shards):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    assert {(r.law, r.grown_shard) for r in found} == {("bytes", None)}
    sizes, at = {}, {}
    for r in found:
        sizes[r.text_crc32] = sizes.get(r.text_crc32, 0) + r.size
        at.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(at[c]) == 1 for c, n in sizes.items() if n <= sum(loads) / shards)  # only what no shard could hold is split
    return loads, at


def test_shards(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["", None, "é"]) if k % 9 == 0 else "".join(rng.choices("abc é", k=rng.randrange(1, 400)))) for k in range(3000)]
    rows += [(5000 + k, "copy " * 20) for k in range(300)] + [(7, rows[7][1])] * 3 + [(None, "no id")]
    loads, _ = check_shards(rows, sharding.shard_rows(docs(spark, rows), unit_rows=50).collect())
    assert max(loads) - min(loads) <= 0.02 * sum(loads) / 8


def test_a_group_heavier_than_a_shard_is_dealt_out(spark):
    loads, at = check_shards(rows := [(k, "same " * 50 if k % 3 else f"own {k}") for k in range(2400)], sharding.shard_rows(docs(spark, rows)).collect())
    assert max(loads) - min(loads) <= 0.03 * sum(loads) / 8 and len(at[zlib.crc32(b"same " * 50)]) == 8


def test_a_group_lighter_than_a_shard_stays_whole(spark):
    rows = [(k, "same " * 50 if k < 95 else f"own text {k} " * 19) for k in range(900)]
    loads, at = check_shards(rows, sharding.shard_rows(docs(spark, rows)).collect())
    assert 0.75 < 251 * 95 / (sum(loads) / 8) < 1 and max(loads) - min(loads) <= 0.03 * sum(loads) / 8


def test_shards_of_an_empty_table(spark):
    assert sharding.shard_rows(docs(spark, [])).count() == 0


def test_slots_are_fixed(spark):
    few, many = docs(spark, [(1, "x"), (2, "y"), (3, None)]), docs(spark, [(k, "x" if k % 2 else "z" * k) for k in range(300)])
    slots = {(r.text_crc32, r.vslot) for r in sharding.slot_rows(few).unionByName(sharding.slot_rows(many)).collect()}
    assert len({crc for crc, _ in slots}) == len(slots)


def test_the_registered_query_places_by_the_stored_map(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    found = queries.op10_sharding(spark, sf_dir).collect()
    loads, _ = check_shards(rows, found)
    heaviest = max(len(t.encode()) + 1 for _, t in rows if t)
    assert max(loads) - min(loads) <= max(heaviest, 0.02 * sum(loads) / 8) and {r.version for r in found} == {2}
    # the same by hand: entries heaviest first, each on its first shard while that holds, else on the lightest one
    slots = {r.text_crc32: r.vslot for r in found}
    total = {}
    for i, t in rows:
        total[t or ""] = total.get(t or "", 0) + len((t or "").encode()) + 1
    share = sum(total.values()) / 8
    digests = {r.text: r.d for r in documents.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("d")).collect()}
    entries = {}
    slot_bytes = {}
    for t, n in total.items():
        slot = digests[t] % 4096
        assert slots[zlib.crc32(t.encode())] == slot
        slot_bytes[slot] = slot_bytes.get(slot, 0) + n
    for t, n in total.items():
        slot = digests[t] % 4096
        key = (slot, digests[t]) if n > share / 16 and slot_bytes[slot] > share / 16 else (slot, None)
        entries.setdefault(key, []).append((t, n))
    weight = {key: sum(n for _, n in x) for key, x in entries.items()}
    loads, where = [0] * 8, {}
    for key in sorted(entries, key=lambda e: (-weight[e], e[0], e[1] is not None, e[1] or 0)):
        first = key[0] % 8
        shard = first if loads[first] + weight[key] <= 1.005 * share else loads.index(min(loads))
        loads[shard] += weight[key]
        where |= {zlib.crc32(t.encode()): shard for t, _ in entries[key]}
    assert all(where[r.text_crc32] == r.shard for r in found)


def test_maps_are_edited_and_kept_by_version(spark, tmp_path):
    path, rng = str(tmp_path / "map"), random.Random(2)
    rows = [(k, "".join(rng.choices("abc é", k=rng.randrange(1, 300)))) for k in range(3000)]
    first = {r.doc_id: r for r in sharding.shard_rows(docs(spark, rows), 4, path=path).collect()}
    grown = rows + [(9000 + k, "more " * 80 + str(k)) for k in range(400)]
    second = {r.doc_id: r for r in sharding.shard_rows(docs(spark, grown), 5, path=path).collect()}
    assert {r.version for r in first.values()} == {2} and {r.version for r in second.values()} == {3}
    assert sharding.latest_version(spark, path) == 3 and sharding.load_map(spark, path, 1).count() > 0
    loads = [sum(r.size for r in second.values() if r.shard == s) for s in range(5)]
    assert max(loads) <= 1.02 * sum(loads) / 5
    assert all(first[k].vslot == second[k].vslot for k in first)
    assert sum(first[k].shard != second[k].shard for k in first) <= 0.35 * len(first)
    with pytest.raises(Exception, match="exist"):
        sharding.save_map(sharding.load_map(spark, path, 3).drop("version"), path, 3)


def test_maps_keep_slots_that_later_runs_do_not_touch(spark, tmp_path):
    path = str(tmp_path / "map")
    heavy = "heavy " * 40
    rows = [(k, f"text {k} " * 9) for k in range(300)] + [(1_000 + k, heavy) for k in range(12)]
    sharding.shard_rows(docs(spark, rows), path=path).count()
    key = lambda r: (r.vslot, r.digest, r.part)
    first, second = ({key(r): r for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2))
    assert len(first) == sharding.SLOTS and first.keys() < second.keys()
    assert sum(r.bytes for r in second.values()) == sum(len(t) + 1 for _, t in rows)
    new = [(5_000 + k, f"new text {k}") for k in range(20)] + [(6_000, heavy)]
    found = sharding.shard_rows(docs(spark, new), path=path, further=True).collect()
    third = {key(r): r for r in sharding.load_map(spark, path, 3).collect()}
    touched = {r.vslot for r in found}
    assert second.keys() <= third.keys() and all(r.shard in range(8) for r in third.values())
    assert all(third[k].bytes == r.bytes for k, r in second.items() if k[0] not in touched)
    assert sum(third[k].shard != r.shard for k, r in second.items() if r.bytes) <= 0.1 * len(rows)
    assert sum(r.bytes for r in third.values()) == sum(len(t) + 1 for _, t in rows + new)
    ((digest, part),) = {(k[1], k[2]) for k in second if k[1] is not None}
    assert {r.shard for r in found if r.doc_id == 6_000} == {third[next(r.vslot for r in found if r.doc_id == 6_000), digest, part].shard}
    sharding.shard_rows(docs(spark, new), path=path).count()  # measured anew
    fourth = {key(r): r for r in sharding.load_map(spark, path, 4).collect()}
    assert fourth.keys() == third.keys() and sum(r.bytes for r in fourth.values()) < sum(r.bytes for r in third.values())


def test_heavy_copies_of_one_id_are_dealt_out(spark):
    rows = [(7, "same " * 50)] * 1_200 + [(k, f"own {k}") for k in range(300)] + [(None, None)] * 900
    table = docs(spark, rows).repartition(12)
    loads, at = check_shards(rows, sharding.shard_rows(table, unit_rows=40).collect())
    assert len(at[zlib.crc32(b"same " * 50)]) == 8 and max(loads) - min(loads) <= 0.1 * sum(loads) / 8
