"""Single files that are cut into many splits."""

import json
import random

import pytest

from stratalog.model import QueryError
from stratalog.sources import ranges
from stratalog.sources import readers as src


@pytest.fixture()
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("1501", "0")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def put(folder, name, text):
    with open(f"{folder}/{name}", "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return f"{folder}/{name}"


def test_one_csv_file_in_many_tasks(spark, folder, small_splits):
    draw = random.Random(3)
    words = ["plain", "", 'say \\"so', "a,b", "two\nlines", "\n\n", "x" * 200, "5 in", "é\r\nü", ",\n,"]
    want, text = [], "id,note\n"
    for i in range(400):
        value = draw.choice(words) + draw.choice(words)
        quoted = any(c in value for c in '",\n') or draw.random() < 0.3
        want.append((str(i), value.replace('\\"', '"') or None))
        text += f'{i},"{value}"\n' if quoted and value else f"{i},{value}" + draw.choice(["\n", "\r\n", "\n\n"])
    text += '7" disk,1,2\nlast,"open'
    good, bad = src.read_csv_records(spark, put(folder, "a.csv", text))
    got = {r.id: r.note for r in good.collect()}
    assert ranges._chunks(spark, f"{folder}/a.csv", "\n").rdd.getNumPartitions() > 3
    for key, value in want:
        assert (got[key] or "").replace("\r", "") == (value or "").replace("\r", ""), key
    assert set(got) - {k for k, _ in want} <= {"last"}
    assert '7" disk,1,2' in [r.record for r in bad.collect()]


def test_quotes_open_at_the_start_of_a_value_only():
    cases = {'a,"b': True, 'a"b,c"': False, '"a""b': False, '"a\\"b': True, '"a",x"': False, '"a","': True, "": False}
    for line, want in cases.items():
        assert ranges.quoted_after(line, False) == want, line
    assert ranges.quoted_after('b",c', True) is False and ranges.quoted_after("b,c", True) is True
    assert ranges.quoted_after('b","c', True) is True


def test_one_json_array_in_many_tasks(spark, folder, small_splits):
    draw = random.Random(4)

    def value(depth):
        kind = draw.randrange(7 if depth < 3 else 4)
        if kind < 4:
            return [draw.randrange(100), 'br } ] [ { , "q" \\ é', None, "y" * draw.randrange(90)][kind]
        if kind == 4:
            return [value(depth + 1) for _ in range(draw.randrange(4))]
        return {f"k{i}": value(depth + 1) for i in range(draw.randrange(5))}

    for name, indent in (("flat", None), ("wide", 2)):
        items = [value(0) for _ in range(200)]
        path = put(folder, f"{name}.json", " \n" + json.dumps(items, indent=indent, ensure_ascii=False) + "\n")
        got = {r.position: json.loads(r.line) for r in ranges.array_elements(spark, path).collect()}
        assert got == dict(enumerate(items))
        assert ranges._chunks(spark, path, "}").rdd.getNumPartitions() > 3
        good, bad = src.read_json_array(spark, path)
        assert good.count() == sum(isinstance(x, dict) for x in items) and good.count() + bad.count() == len(items)


def test_arrays_that_are_none(spark, folder):
    for n, text in enumerate(('[{"a": 1}', '[{"a": "}]', '{"a": [1]}', '[1]]', "7", '[{"a": 1}}]')):
        with pytest.raises(QueryError):
            src.read_json_array(spark, put(folder, f"bad{n}.json", text))
    for n, (text, good, bad) in enumerate((("[]", 0, 0), ("[ \n ]", 0, 0), ('[{"a": 1},]', 1, 1), ("[,]", 0, 2), ('[{}] x', 1, 1), ("[1, [2]]", 0, 2))):
        found = src.read_json_array(spark, put(folder, f"odd{n}.json", text))
        assert (found[0].count(), found[1].count()) == (good, bad), text
