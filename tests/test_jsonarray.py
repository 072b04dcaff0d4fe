"""The splittable scan of one JSON array."""

import json
import random

import numpy as np
import pytest

from incidence.sources import incidents, jsonarray


def random_value(rng, depth=0):
    texts = ['a"b', "\\", "\\\\\"", "],[{", "}", "é😀", "", "\n", "x" * rng.randint(0, 40), "Приморский край"]
    kind = rng.randint(0, 5 if depth < 3 else 3)
    if kind < 3:
        return rng.choice(texts)
    if kind == 3:
        return rng.choice([1, -2.5, None, True])
    if kind == 4:
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(texts): random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def plain_scan(data):
    """(state, depth) before every byte, one byte after the other."""
    state, depth, out = jsonarray.PLAIN, 0, []
    for b in data:
        out.append((state, depth))
        if state == jsonarray.ESCAPED:
            state = jsonarray.STRING
        elif state == jsonarray.STRING:
            state = {ord("\\"): jsonarray.ESCAPED, ord('"'): jsonarray.PLAIN}.get(b, state)
        elif b == ord('"'):
            state = jsonarray.STRING
        else:
            depth += {ord("["): 1, ord("{"): 1, ord("]"): -1, ord("}"): -1}.get(b, 0)
    return [*out, (state, depth)]


@pytest.mark.parametrize("ascii_only", [True, False])
def test_every_cut_gives_every_element_once(ascii_only):
    rng = random.Random(3)
    for _ in range(60):
        values = [{"k": random_value(rng)} for _ in range(rng.randint(0, 6))]
        data = json.dumps(values, ensure_ascii=ascii_only, indent=rng.choice([None, 1])).encode()
        states = plain_scan(data)
        for at in range(len(data)):
            block = np.frombuffer(data[at:], np.uint8)
            assert jsonarray.summary(block, states[at][0]) == (states[-1][0], states[-1][1] - states[at][1])
        split, step = rng.randint(1, 25), rng.randint(1, 9)
        read = lambda at, n: data[at : at + n]  # noqa: E731, B023
        found = [e for a in range(0, len(data), split) for e in jsonarray.elements(read, jsonarray.Range("", a, min(a + split, len(data)), *states[a]), step)]
        assert [json.loads(e) for e in found] == values


def records(n):
    rng = random.Random(5)
    for i in range(n):
        yield {"EM_NUMBER": str(i), "EM_DATE": "2024-01-02 03:04:05", "EM_TYPE": 'a "quoted" [{,\\ text' * rng.randint(0, 9), "REGIONS": [rng.choice(["Приморский край", "Other"])], "LOST_AMOUNT": i % 3, "VEHICLES": [{"N_TS": 1, "PERSONS": [{"SEX": "}]"}]}]}


@pytest.mark.parametrize("ascii_only", [True, False])
def test_same_rows_as_the_reader_of_whole_files(spark, tmp_path, ascii_only):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(list(records(700)), ensure_ascii=ascii_only))
    for region in (None, "Приморский"):
        whole = incidents.read_incidents(spark, str(path), region)
        parted = incidents.read_incident_array(spark, f"file://{path}", region, split=4096)
        assert parted.rdd.getNumPartitions() == -(-path.stat().st_size // 4096) > 20
        assert parted.columns == whole.columns and sorted(map(str, parted.collect())) == sorted(map(str, whole.collect()))


def test_the_region_is_pushed_to_the_scan(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"EM_NUMBER": str(i), "REGIONS": [("Приморский край", "Other")[i % 2]]} for i in range(100)], ensure_ascii=False))
    assert jsonarray.read_array(spark, str(path), incidents.INCIDENT, "Приморский").count() == 50
    path.write_text(json.dumps([{"EM_NUMBER": str(i), "REGIONS": ["Приморский край"]} for i in range(100)]))
    assert incidents.read_incident_array(spark, str(path), "Приморский").count() == 100


def test_empty_and_broken_arrays(spark, tmp_path):
    for text, n in (("", 0), ("[]", 0), (" [ ] ", 0), ("[{}]", 1), ('[{"EM_NUMBER":"1"}, 5 ]', 2)):
        (tmp_path / "e.json").write_text(text)
        assert incidents.read_incident_array(spark, str(tmp_path / "e.json"), split=3).count() == n
    for text in ("[{}", '[{"a": "b]'):
        (tmp_path / "e.json").write_text(text)
        with pytest.raises(ValueError, match="not closed"):
            incidents.read_incident_array(spark, str(tmp_path / "e.json"))
    with pytest.raises(FileNotFoundError):
        incidents.read_incident_array(spark, str(tmp_path / "none.json"))
