"""The rule catalogue in SQL: what each rule finds, and the greedy resolution of all of it.

RE2 has no look-around.  So each text is walked match by match: a step takes the first match behind one character of
context, and goes on behind the value, with the value's last character as the next step's context.
"""

from __future__ import annotations

import re

from veilframe.operators.privacy import Policy
from veilframe.operators.rules import ENTITY_TYPES, PACKS, Rule

LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE WHEN (length(d) - k) % 2 = 0 THEN d[k]::INT ELSE CASE WHEN d[k]::INT > 4 THEN 2 * d[k]::INT - 9 ELSE 2 * d[k]::INT END END)) % 10 = 0"""
_D = "regexp_replace(value, '[^0-9]', '', 'g')"
_W17 = str([2 ** (17 - k) % 11 for k in range(17)])
_W11 = str([k + 1 if k <= 6 else k - 5 for k in range(11, 0, -1)])
_DIGIT = lambda v, n, w: f"list_sum(list_transform(range(1, {n + 1}), lambda k: {v}[k]::INT * {w}[k]))::BIGINT"
_OCTET = lambda k: f"string_split(value, '.')[{k}]::INT"


def _checks() -> dict[str, str]:
    """Each validator over ``value``."""
    from veilframe.functions.checks import NOT_NAMES

    a, b, c, d = map(_OCTET, (1, 2, 3, 4))
    nets = f"({a} IN (0, 10, 127) OR {a} >= 240 OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} = 168) OR ({a} = 169 AND {b} = 254) OR ({a} = 198 AND {b} IN (18, 19)) OR ({a} = 192 AND {b} = 0 AND {c} IN (0, 2)) OR ({a} = 198 AND {b} = 51 AND {c} = 100) OR ({a} = 203 AND {b} = 0 AND {c} = 113))"
    return {
        "luhn": f"length({_D}) >= 13 AND {LUHN.replace('d[', _D + '[').replace('length(d)', f'length({_D})')}",
        "ssn": f"regexp_matches({_D}, '^[0-8][0-9]{{8}}$') AND left({_D}, 3) NOT IN ('000', '666') AND substr({_D}, 4, 2) <> '00' AND right({_D}, 4) <> '0000'",
        "mod_11_2": f"upper(right(value, 1)) = substr('10X98765432', {_DIGIT('value', 17, _W17)} % 11 + 1, 1)",
        "my_number": f"length({_D}) = 12 AND right({_D}, 1)::INT = CASE WHEN {_DIGIT(_D, 11, _W11)} % 11 <= 1 THEN 0 ELSE 11 - {_DIGIT(_D, 11, _W11)} % 11 END",
        "private_ipv4": f"greatest({a}, {b}, {c}, {d}) <= 255 AND {nets}",
        "looks_secret": r"(length(value) >= 12 OR regexp_matches(value, '[\p{Nd}\p{Lu}]|[^\p{L}\p{N}]'))",
        "mixed_kinds": "regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')",
        "latin_name": rf"NOT regexp_matches(value, '\b(?:{'|'.join(NOT_NAMES)})\b')",
        "no_opener": rf"NOT regexp_matches(value, '^(?:{'|'.join(NOT_NAMES[:35])})\b')",
        "no_system_account": "value NOT IN ('root', 'admin', 'shared', 'public', 'default', 'ubuntu', 'runner', 'guest')",
        "no_standard": "NOT regexp_matches(value, '^(?:ISO|RFC|IEEE|UTF|SHA|IEC|CVE|HTTP)-')",
        "han_name": "NOT regexp_matches(value, '(?:部|課|社|会|県|市|区|町|村|駅|店|省|局|係|様|年|月|日|中|的|是|了|在|有|和|与|及|公司|集团|大学|学校)$')",
    }


def walk_pattern(rule: Rule) -> str:
    """What a step looks for: group 1 all before the value, group 2 the value."""
    p = rule.pattern
    flags = "(?i)" if p.startswith("(?i)") else ""
    p = p.removeprefix("(?i)")
    p = re.sub(r"\\p\{Is(Han|Hiragana|Katakana)\}", r"\\p{\1}", p)
    p = re.sub(r"\{(\d+),(\d{4,})\}", r"{\1,}", p)
    behind = r"\(\?<!(\[[^\]]*\]|\\p\{Han\})\)"
    before = lambda s: re.sub(behind, lambda m: "[^" + m[1].removeprefix("[").removesuffix("]") + "]", s, count=1)
    if rule.grouped:  # (prefix)(value) and maybe what must follow
        depth, i = 0, 0
        for i, c in enumerate(p):  # the prefix's end
            depth += (c == "(" and p[i - 1 : i] != "\\") - (c == ")" and p[i - 1 : i] != "\\")
            if not depth:
                break
        prefix, rest = p[1:i], p[i + 1 :]
        prefix = before(prefix) if "(?<!" in prefix else prefix
    else:
        m = re.match(behind, p)
        prefix, rest = (before(m[0]), p[m.end() :]) if m else ("", p)
        ahead = re.search(r"\(\?!(?:[^()]|\([^()]*\))*\)$", rest)
        rest = f"({rest[: ahead.start()]}){ahead[0]}" if ahead else f"({rest})"
    rest = re.sub(r"\(\?!(\[[^\]]*\]|\\p\{Han\})\)$", lambda m: "(?:[^" + m[1].removeprefix("[").removesuffix("]") + "]|$)", rest)
    rest = rest.replace(r"(?![0-9]|\.[0-9])", r"(?:$|[^0-9.]|\.(?:$|[^0-9]))")
    rest = rest.replace("(?![0-9]|[ -][0-9])", "(?:$|[^0-9 -]|[ -](?:$|[^0-9]))")
    rest = re.sub(r"\(\?=", "(?:", rest)
    return rf"{flags}^([\s\S]{'*' if prefix.startswith('[^') else '+'}?(?:{prefix})){rest}"


def candidates(rules: list[Rule], name: str = "cand") -> str:
    """Common tables that end in ``name`` (doc_id, lang, rule, s, e, value, type, conf, source, sev, cat), to follow WITH RECURSIVE."""
    quote = lambda s: s.replace("'", "''")
    checks = _checks()
    script = {p: (t or "").replace(r"\p{Is", r"\p{") for p, (_, t, _) in PACKS.items()}
    rows = ", ".join(f"('{r.id}', '{quote(walk_pattern(r))}', '{r.type}', {float(r.confidence)}::DOUBLE, '{r.pack}', {ENTITY_TYPES[r.type][0]}, '{ENTITY_TYPES[r.type][1]}', '{r.validator or ''}', '{script.get(r.pack, '')}')" for r in rules)
    valid = " ".join(f"WHEN '{k}' THEN {v}" for k, v in checks.items() if any(r.validator == k for r in rules))
    return rf"""rules(rule, rx, type, conf, source, sev, cat, valid, script) AS (VALUES {rows}),
    step AS (
      SELECT rule, rx, doc_id, chr(10) || text AS rest, 0 AS pos, NULL::VARCHAR AS value, 0 AS s FROM rules, documents WHERE text IS NOT NULL AND regexp_matches(text, script)
      UNION ALL
      SELECT rule, rx, doc_id, right(v, 1) || substr(rest, length(b) + length(v) + 1), pos + length(b) - 1 + length(v), v, pos + length(b) - 1
      FROM (SELECT *, regexp_extract(rest, rx, 1) AS b, regexp_extract(rest, rx, 2) AS v FROM step) WHERE v <> ''),
    {name} AS (
      SELECT doc_id, rule, s, s + length(value) AS e, value, type, conf, source, sev, cat FROM step JOIN rules USING (rule)
      WHERE value IS NOT NULL AND CASE valid {valid or "WHEN '?' THEN true"} ELSE true END)"""


RANK = "-(e - s), -sev, -conf, s, source, type"


def resolution(name: str = "kept", cand: str = "cand") -> str:
    """Common tables that end in ``name`` (doc_id, k): candidates that greedy resolution keeps, one struct each, and ``ranked``/``held``."""
    row = "{'s': s, 'e': e, 'type': type, 'value': value, 'rule': rule, 'conf': conf, 'sev': sev, 'source': source, 'cat': cat}"
    other = row.replace("': ", "': c.")
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {RANK}) AS rk FROM {cand}),
    fold(doc_id, rk, acc) AS (
      SELECT doc_id, rk, [{row}] FROM ranked WHERE rk = 1
      UNION ALL
      SELECT c.doc_id, c.rk, CASE WHEN len(list_filter(f.acc, lambda k: k.s < c.e AND c.s < k.e)) > 0 THEN f.acc ELSE list_append(f.acc, {other}) END
      FROM fold f JOIN ranked c ON c.doc_id = f.doc_id AND c.rk = f.rk + 1),
    held AS (SELECT doc_id, arg_max(acc, rk) AS acc FROM fold GROUP BY doc_id),
    {name} AS (SELECT doc_id, unnest(acc) AS k FROM held)"""


def actions(policy: Policy, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{t}' THEN '{a}'" for t, a in policy.actions().items()) + " END"
