"""Rule texts are read back and must match the rows that the rules match."""

import random
import re

import pytest

from spillway.functions import rule_text, rules

FIELDS = {"port": "DestinationPort", "proto": "Protocol", "bytes": "BytesSent"}


def unquoted(x):
    return re.sub(r"\\(.)", r"\1", x[1:-1])


def read_query(text):
    """The conditions of a where line as functions of a row."""
    out = []
    for part in text.split(" and "):
        column, op, value = re.fullmatch(r"(\S+) (==|!=|<=|>) (.*)", part).groups()
        out.append({"==": lambda r, c=column, v=value: r[c] == unquoted(v), "!=": lambda r, c=column, v=value: r[c] != unquoted(v), "<=": lambda r, c=column, v=value: r[c] <= float(v), ">": lambda r, c=column, v=value: r[c] > float(v)}[op])
    return lambda r: all(f(r) for f in out)


def read_portable(text):
    """Selection and filter of a portable rule as a function of a row."""
    parts, part, key = {"selection": {}, "filter": {}}, None, None
    for line in text.split("\n"):
        if m := re.fullmatch(r"    (selection|filter):", line):
            part = m[1]
        elif m := re.fullmatch(r"            - (.*)", line):
            parts[part][key].append(m[1])
        elif part and (m := re.fullmatch(r"        (\S+): ?(.*)", line)):
            key = m[1]
            parts[part][key] = [m[2]] if m[2] else []
    names = {v: k for k, v in FIELDS.items()}

    def holds(r, key, values):
        name, _, how = key.partition("|")
        x = r[names[name]]
        return x <= float(values[0]) if how == "lte" else x > float(values[0]) if how == "gt" else x in map(unquoted, values)

    negated = "condition: selection and not filter" in text
    assert negated == bool(parts["filter"])
    return lambda r: all(holds(r, k, v) for k, v in parts["selection"].items()) and not (negated and any(holds(r, k, v) for k, v in parts["filter"].items()))


ODD = ["tcp", 'no "quotes"', "back\\slash", "on"]


def some_rule(rng):
    out = []
    for _ in range(rng.randint(1, 5)):
        if rng.random() < 0.5:
            out.append((f"proto={rng.choice(ODD)}", rng.choice(["<=", ">"]), 0.5))
        else:
            out.append((rng.choice(["port", "bytes"]), rng.choice(["<=", ">"]), float(rng.randrange(100))))
    return out


def plain(conditions, r):
    truth = {c: (1.0 if r[c.partition("=")[0]] == c.partition("=")[2] else 0.0) if "=" in c else r[c] for c, _, _ in conditions}
    return all(truth[c] <= at if op == "<=" else truth[c] > at for c, op, at in conditions)


def test_texts_match_what_rules_match():
    rng = random.Random(6)
    rows = [{"port": float(rng.randrange(100)), "bytes": float(rng.randrange(100)), "proto": rng.choice([*ODD, "other"])} for _ in range(300)]
    portable = 0
    for _ in range(400):
        own = some_rule(rng)
        want = [plain(own, r) for r in rows]
        query = rule_text.query_text(own, "Flows")
        assert query.startswith("// rule: not tested") and [read_query(query.rpartition("| where ")[2])(r) for r in rows] == want
        text = rule_text.portable_rule(own, FIELDS)
        positives = {c for c, op, _ in own if "=" in c and op == ">"}
        only_negative = all("=" in c and op == "<=" for c, op, _ in rules.simplify(own))
        assert (text is None) == (len(positives) > 1 or only_negative)
        if text:
            portable += 1
            assert [read_portable(text)(r) for r in rows] == want
    assert portable > 200


def test_packs():
    made = {"r1": [("port", ">", 80.0)], "r2": [("proto=tcp", "<=", 0.5)], "r3": [("jitter", ">", 1.0)], "r4": [("bytes", "<=", 1.5)]}
    costs = {n: rule_text.Cost(0.98, 2, 100) for n in ("r1", "r2", "r3")}
    texts, none = rule_text.portable_pack(made, FIELDS, costs)
    assert list(texts) == ["r1"] and none == ["r2", "r3"] and "held-out precision 0.980, 2 false alarms in 100 matches" in texts["r1"]
    pack = rule_text.pack_query(made, "Flows", costs)
    assert pack.count("false alarms") == 3 and "r4" not in pack and pack.index('"r1"') < pack.index('"r2"') < pack.index('"r3"') and "3 of 4" in pack
    assert rule_text.pack_query(made, "Flows", {}).endswith("| where false") and rule_text.predicate([]) == "true"
    assert rule_text.portable_rule(made["r1"], FIELDS).split("id: ")[1][:36] == texts["r1"].split("id: ")[1][:36]
    with pytest.raises(ValueError, match="unknown operator"):
        rule_text.predicate([("a", "<", 1.0)])
