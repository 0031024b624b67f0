"""The substring join by index gives what the nested loop gives."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from evtrail.operators import relations, substrings


def test_contains_join_against_the_nested_loop(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abé😀 ") for _ in range(n))
    keys = [(i, r.choice(["x", "y", None]), r.choice([None, "", word(1), word(3), word(r.randint(8, 14)), "https://a.b/" + word(4)])) for i in range(120)]
    texts = [(i, r.choice(["x", "y", "z", None]), None if i == 3 else "".join(word(r.randint(0, 30)) + (r.choice(keys)[2] or "") for _ in range(r.randint(0, 6)))) for i in range(150)]
    texts += [texts[5], (900, "x", "")]
    keys += [keys[5], keys[6]]
    left = spark.createDataFrame(texts, "event_id long, scope string, text string").repartition(3)
    right = spark.createDataFrame(keys, "link_id long, scope string, url string").repartition(3)
    got = substrings.contains_join(left, right, ["scope"], [(F.col("text"), F.col("url"))]).select("event_id", "link_id").collect()
    want = [(i, j) for i, s, t in texts for j, k, u in keys if s is not None and s == k and t is not None and u and u in t]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 300


def test_links_by_url_or_token_come_once(spark):
    links = spark.createDataFrame([("o", "d", "https://x.org/docx/AbCdEf12?a=1"), ("o", "d", "https://x.org/docx/AbCdEf12?a=1"), ("p", "d", "https://x.org/docx/AbCdEf12"), ("o", "d", " "), ("o", "d", None)], "owner_id string, date string, url string")
    events = spark.createDataFrame([(1, "o", "d", "see https://x.org/docx/AbCdEf12?a=1 now"), (2, "o", "d", "AbCdEf12 only"), (3, "o", "d", "abcdef12"), (4, "o", "d", None)], "event_id long, owner_id string, date string, text string")
    got = relations.attach_mentioned_links(events, links).select("event_id", "owner_id").collect()
    assert sorted(map(tuple, got)) == [(1, "o"), (1, "o"), (2, "o"), (2, "o")]  # the link is there twice
    assert relations.attach_mentioned_links(events.limit(0), links).count() == 0 == relations.attach_mentioned_links(events, links.limit(0)).count()


def test_a_day_of_very_many_links(spark):
    links = spark.range(100_000).select(F.lit("o").alias("owner_id"), F.lit("d").alias("date"), F.concat(F.lit("https://x.org/long/common/head/"), F.sha1(F.col("id").cast("string"))).alias("url"))
    events = spark.range(2_000).select("id", F.lit("o").alias("owner_id"), F.lit("d").alias("date"), F.concat(F.lit("see https://x.org/long/common/head/"), F.sha1((F.col("id") * 7).cast("string")), F.lit(" and more")).alias("text"))
    got = relations.attach_mentioned_links(events, links)
    assert got.count() == 2_000 and got.where("not contains(text, url)").count() == 0


def test_pairs_of_several_conditions_come_once(spark):
    r = random.Random(9)
    words = ["charset", "paragraph", "zebra", "ab"]
    urls = [f"http://h.example/{r.choice(words)}/{n}" for n in range(12)] * 2 + ["", None, "http://h.example/zebra/1"]
    links = [(i, f"s{i % 2}", u, r.choice([*words, "", None])) for i, u in enumerate(urls)]
    texts = [(i, f"s{i % 2}", " ".join(r.choice([*words, *urls[:12]]) for _ in range(3))) for i in range(40)] + [(99, "s0", None)]
    left = spark.createDataFrame(texts, "event_id long, scope string, text string")
    right = spark.createDataFrame(links, "link_id long, scope string, url string, word string")
    want = sorted((e, i) for e, a, t in texts for i, b, u, w in links if a == b and t is not None and any(k and k in t for k in (u, w)))
    both = [(F.col("text"), F.col("url")), (F.col("text"), F.col("word"))]
    for dealt in (1000, 2):
        df = substrings.contains_join(left, right, ["scope"], both, dealt).select("event_id", "link_id")
        assert sorted(tuple(x) for x in df.collect()) == want
    # the hashes of texts that no key has are not shuffled
    anchor = spark.createDataFrame([(5,), (6 + (1 << 40),)], "hash long")
    bits = substrings._sieve(anchor)
    assert [int(bits[h >> 3] >> (h & 7) & 1) for h in (4, 5, 6, 7)] == [0, 1, 1, 0]
