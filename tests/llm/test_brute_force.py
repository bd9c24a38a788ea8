"""Queries and operators without SQL, against versions that take the long way."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import regex
from test_tokens_pii import EMAIL, plain_spans

from tablemill.llm import mixing, pii
from tablemill.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_slots_are_those_of_a_scheduler_that_looks_at_every_block(spark):
    """At each slot the released block with the earliest deadline, in exact fractions, straight from the definition."""
    got = QUERIES["op7_source_mix"](spark, FOLDER).collect()
    sizes = Counter(r.source for r in got)
    order = sorted(sizes, key=lambda s: (s is None, str(s)))
    total = sum(Fraction(n**mixing.TEMPERATURE) for n in sizes.values())
    rate = [Fraction(sizes[s] ** mixing.TEMPERATURE) / total for s in order]
    last = max(r.mix_slot for r in got)
    done, slot_of = [0] * len(order), {}
    for now in range(last + 1):
        due = [(math.ceil((k + 1) / rate[i]), i) for i, k in enumerate(done) if math.floor(k / rate[i]) <= now]
        _, i = min(due)
        slot_of[order[i], done[i]] = now
        done[i] += 1
    for r in got:
        assert slot_of[r.source, r.mix_block] == r.mix_slot
    places = defaultdict(list)
    for r in got:
        places[r.source].append((r.mix_block, r.mix_offset))
    assert all(sorted(p) == [(n // mixing.BLOCK, n % mixing.BLOCK) for n in range(len(p))] for p in places.values())


def terms_of(text):
    return set(regex.findall(pii.TERM, EMAIL.sub(" ", text).lower()))


def plain_disclosures(texts, discloses, names):
    lines = Counter(line for t in texts if t for line in t.split("\n") if line)
    total = sum(lines.values())
    held, entity_lines, near, different, kinds = Counter(), Counter(), Counter(), defaultdict(set), {}
    for line, times in lines.items():
        for term in terms_of(line):
            held[term] += times
        entities = defaultdict(set)
        for start, _, kind, end in plain_spans(line):
            value = line[start:end]
            name = f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else re.sub('[^0-9]', '', value)}"
            kinds[name] = kind
            before, after = line[max(0, start - pii.NEAR) : start], line[end : end + pii.NEAR]
            if start > pii.NEAR:
                before = re.sub(r"^\S+", "", before)
            if len(line) > end + pii.NEAR:
                after = re.sub(r"(?<!\S)\S+$", "", after)
            entities[name] |= terms_of(f"{before} {after}")
        for name, terms in entities.items():
            entity_lines[name] += times
            for term in terms:
                near[term, name] += times
                different[term, name].add(line)
    best = {}
    for (term, name), both in near.items():
        own = math.log(total / entity_lines[name])
        if len(different[term, name]) >= pii.SUPPORT and own > 0:
            weight = math.log(both * total / held[term] / entity_lines[name]) / own
            if weight >= discloses:
                best[term] = max(best.get(term, (0, "")), (weight, kinds[name]))
    return {t: "" if w >= names else f"[{kind} context]" for t, (w, kind) in best.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_terms_that_disclose_are_those_of_a_plain_count(spark, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}ing" for a in "bdfgkl" for b in "aeiou" for c in "mnprst"]
    entities = ["jo@zoo.example", "+44 20 7946 0958", "10.2.3.4", "4539578763621486", "ann@a.example"]
    texts = []
    for i in range(160):
        lines = []
        for _ in range(rng.randint(1, 3)):
            line = rng.choices(words, k=rng.randint(3, 40))
            if rng.random() < 0.4:
                e = rng.randrange(len(entities))
                # a word of the entity's own, one that leaks to other lines, and common ones
                line += [f"keeper{'abcde'[e]}", entities[e], f"friend{'abcde'[e]}" if rng.random() < 0.9 else "nobody"]
            elif rng.random() < 0.08:
                line.insert(0, f"friend{rng.choice('abcde')}")
            lines.append(" ".join(line))
        texts.append("\n".join(lines))
    texts += [texts[0]] * 4 + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.term: r.label for r in pii.disclosing_terms(docs).collect()}
    assert got == plain_disclosures(texts, pii.DISCLOSES, pii.NAMES) and any(t.startswith("keeper") for t in got)
