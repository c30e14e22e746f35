"""Log queries on small tables: parsers and their odd lines, errors in metrics, templates, deletions."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators import log_analytics
from quadrille.plans import logql
from quadrille.plans.lexing import QueryError

SCHEMA = "labels map<string,string>, ts_ns long, line string, metadata map<string,string>"
SECOND = 10**9


def table(spark, lines, labels=None):
    return spark.createDataFrame([(labels or {"app": "x"}, (k + 1) * SECOND, line, {}) for k, line in enumerate(lines)], SCHEMA)


def run(spark, lines, pipeline, labels=None):
    rows = logql.query_logs(table(spark, lines, labels), '{app="x"} ' + pipeline, 0, 10**18).collect()
    return [(r.labels, r.line, r.err) for r in sorted(rows, key=lambda r: r.ts_ns)]


def flat(line: str) -> dict:
    """Depth first, first of equal names, without arrays and nulls."""
    out: dict = {}

    def walk(prefix: str, pairs: list) -> None:
        for k, v in pairs:
            name = prefix + "".join(c if c.isascii() and (c.isalnum() or c in "_:") else "_" for c in k)
            if isinstance(v, Pairs):
                walk(name + "_", v)
            elif v is not None and not isinstance(v, list):
                out.setdefault(name, v if isinstance(v, str) else json.dumps(v))

    walk("", json.loads(line, object_pairs_hook=Pairs))
    return out


class Pairs(list):
    pass


def made(rng: random.Random, depth: int) -> str:
    keys = ["a", "b", "a_b", "a.b", "c-d", "é"]
    value = lambda d: rng.choice([lambda: rng.randrange(100), lambda: "text {x", lambda: True, lambda: None, lambda: [1, {"z": 2}], lambda: rng.random() < 0.5])() if d == 0 or rng.random() < 0.4 else {k: value(d - 1) for k in rng.sample(keys, rng.randrange(0, 4))}
    return json.dumps({k: value(depth) for k in rng.sample(keys, 4)})


def test_json_equals_a_plain_walk(spark):
    rng = random.Random(3)
    lines = [made(rng, d) for d in (0, 1, 2, 4, 6) for _ in range(12)]
    lines += ['{"a":{"b":"first","b":"second"},"a_b":"later","a":{"c":7},"tail":true}', '{"x":' * 12 + '{"level":"error"}' + "}" * 12, '{"a_b_c_d":"{\\"e\\":1}"}', "{}"]
    got = run(spark, lines, "| json")
    for (labels, line, err), source in zip(got, lines, strict=True):
        assert line == source and err == ""
        assert {k: v for k, v in labels.items() if k != "app"} == flat(source), source


def test_json_errors_and_taken_names(spark):
    got = run(spark, ['{"app":"own","app_extracted":"older","b":1', '{"app":"own","app_extracted":"third","k":1}', "[1]", "text"], "| json")
    assert [err for _, _, err in got] == ["JSONParserErr", "", "JSONParserErr", "JSONParserErr"]
    assert got[1][0] == {"app": "x", "app_extracted": "own", "k": "1"}
    twice = run(spark, ['{"app":"one"}'], "| json | json")
    assert twice[0][0] == {"app": "x", "app_extracted": "one"}


def test_logfmt(spark):
    got = run(spark, ['a.b=1 a-b=2 c="x \\"y\\" z" d= bare e=5', 'a=1 b="open', "nothing here"], "| logfmt")
    assert [{k: v for k, v in r[0].items() if k != "app"} for r in got] == [{"a_b": "1", "c": 'x "y" z', "e": "5"}, {"a": "1"}, {}]
    strict = run(spark, ["a=1 bare b=2", 'a=1 b="open', "=x"], "| logfmt --strict")
    assert [err for _, _, err in strict] == ["", "LogfmtParserErr", "LogfmtParserErr"]
    assert run(spark, ["d= e=5"], "| logfmt --keep-empty")[0][0] == {"app": "x", "d": "", "e": "5"}


def test_filters_move_before_parsers():
    kinds = lambda text: [s.kind for s in logql.filters_first(logql.parse(text).stages)]
    assert kinds('{a="b"} | json | c = "d" |= "e"') == ["line", "json", "filter"]
    assert kinds('{a="b"} | json | line_format "x" |= "e" | logfmt |= "f"') == ["json", "line_format", "line", "line", "logfmt"]


@pytest.mark.parametrize("fn", ["count_over_time", "rate", "bytes_over_time", "present_over_time", "absent_over_time"])
def test_rows_with_errors_fail_metrics(spark, fn):
    logs = table(spark, ['{"v":1}', "broken"])
    with pytest.raises(Exception, match="pipeline error: JSONParserErr"):
        logql.query_metrics(logs, f'{fn}({{app="x"}} | json [1m])', 0, 60_000, 60_000).collect()
    rows = logql.query_metrics(logs, f'count_over_time({{app="x"}} | json | __error__="" [1m])', 0, 60_000, 60_000).collect()
    assert [r.value for r in rows] == [1.0]


TEMPLATES = {
    "plain": "plain", "{{.app}}-{{ .none }}": "x-", "{{ .n | add 2 | mul 3 }}": "21", '{{ if eq .app "x" }}yes{{ else }}no{{ end }}': "yes", '{{ if gt (int .n) 9 }}big{{ else if ge (int .n) 5 }}mid{{ else }}small{{ end }}': "mid",
    '{{ if and (contains "or" .w) (not .none) }}a{{ end }}': "a", '{{ with .w }}<{{ . }}>{{ end }}{{ with .none }}never{{ end }}': "<word>", '{{ $x := .w | upper }}{{ $x }}{{ $x | lower }}': "WORDword",
    '{{ printf "%s-%05d-%.2f" .w (int .n) (float64 .n) }}': "word-00005-5.00", "a {{- /* gone */ -}} b": "ab", "a {{- .w -}} b": "awordb", '{{ .w | hasPrefix "wo" }}{{ hasSuffix "x" .w }}': "truefalse",
    '{{ trimAll "wd" .w }}|{{ trimPrefix "wo" .w }}|{{ trimSuffix "rd" .w }}|{{ Trim "--a-" "-" }}': "or|rd|wo|a", '{{ indent 2 .w }}{{ nindent 1 .w }}': "  word\n word", '{{ count "[aeiou]" "banana" }}': "3", '{{ divf 1.0 4 }}{{ addf .n 0.5 }}': "0.255.5",
    '{{ "<a&b>" | html }}': "&lt;a&amp;b&gt;", '{{ max 3 .n 4 }}{{ min 3 .n }}{{ maxf 1.5 2 }}': "532", "{{ round 2.456 2 }}|{{ ceil 1.2 }}|{{ floor 1.8 }}": "2.46|2|1", '{{ "1700000000" | unixToTime | date "2006-01-02 15:04:05" }}': "2023-11-14 22:13:20",
    '{{ toDate "2006-01-02" "2024-02-29" | unixEpoch }}': "1709164800", '{{ duration_seconds "1m30s" }}|{{ bytes "2KB" }}': "90|2000", '{{ __line__ | len }}': "4", '{{ substr 1 3 .w }}{{ trunc -2 .w }}{{ trunc 2 .w }}': "orrdwo",
    '{{ regexReplaceAll "(o)(r)" .w "$2${1}" }}{{ regexReplaceAllLiteral "o" .w "$1" }}': "wrodw$1rd", '{{ repeat 3 "ab" }}{{ alignRight 6 .w }}{{ alignLeft 6 .w }}|': "ababab  wordword  |", '{{ default "d" .none }}{{ .w | default "d" }}': "dword", "{{ mod 17 5 }}{{ div -7 2 }}{{ sub 1 2 3 }}": "2-3-4",
    '{{ b64enc "hi" }}{{ b64dec "aGk=" }}{{ urlencode "a b" }}{{ "a%20b" | urldecode }}': "aGk=hia+ba b", '{{ eq .w "a" "word" }}{{ ne .n "5" }}': "truefalse", '{{ print .w .n }}': "word5",
}


def test_templates(spark):
    labels = F.create_map(*[F.lit(x) for x in ("app", "x", "w", "word", "n", "5")])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.range(1).select(*[logql.template(t, labels, F.lit("line")).alias(f"c{k}") for k, t in enumerate(TEMPLATES)])
    row = df.first()
    for k, (t, want) in enumerate(TEMPLATES.items()):
        assert row[k] == want, t


ALERTS = {
    "{{ $labels.instance }} is {{ $value }}": "db:9 is 1234.6", "{{ $value | humanize }} {{ humanize1024 2048.0 }} {{ humanize 0.00123 }} {{ humanize 0.0 }}": "1.235k 2ki 1.23m 0", "{{ humanizePercentage 0.2345 }}": "23.45%",
    "{{ humanizeDuration 93784.0 }}|{{ humanizeDuration 61.0 }}|{{ humanizeDuration 0.25 }}|{{ humanizeDuration 1.5 }}": "1d 2h 3m 4s|1m 1s|250ms|1.5s", "{{ humanizeTimestamp 1700000000.0 }}": "2023-11-14 22:13:20 UTC",
    '{{ if match "^db" $labels.instance }}{{ stripPort $labels.instance | toUpper }}{{ end }}': "DB", '{{ reReplaceAll "(.*):(.*)" "$2" $labels.instance }}': "9", "{{ with $labels.none }}x{{ else }}none{{ end }}": "none",
}


def test_alert_texts(spark):
    from quadrille.plans.templates import alert_text

    labels = F.create_map(F.lit("instance"), F.lit("db:9"))
    row = spark.range(1).select(*[alert_text(t, labels, F.lit(1234.6)).alias(f"c{k}") for k, t in enumerate(ALERTS)]).first()
    for k, (t, want) in enumerate(ALERTS.items()):
        assert row[k] == want, t


def test_alerts(spark):
    from quadrille.plans import promql
    from quadrille.streaming import rules

    rows = [("m", {"host": h}, t * 1000, v) for h, vs in (("a", (5.0, 6.0, 1.0)), ("b", (1.0, 9.0, 9.0))) for t, v in enumerate(vs)]
    store = promql.Store(spark.createDataFrame(rows, "name string, labels map<string,string>, ts long, v double"))
    got = rules.alerts(store, "High", "m > 4", 0, 2000, 1000, hold=1000, labels={"level": "{{ if gt $value 4.0 }}warn{{ end }}"}, annotations={"text": "{{ $labels.host }}: {{ $value }}"}, lookback=1000).collect()
    assert all(r.labels == {"alertname": "High", "level": "warn", "host": r.annotations["text"][0]} for r in got)
    assert sorted((r.ts, r.state, r.annotations["text"]) for r in got) == [(0, "pending", "a: 5"), (1000, "firing", "a: 6"), (1000, "pending", "b: 9"), (2000, "firing", "b: 9")]


@pytest.mark.parametrize("text", ["{{ nothing 1 }}", "{{ if .a }}x", "{{ end }}", "{{ $x }}", "{{ (.a }}", "{{ range .a }}{{ end }}", "{{ replace }}", "{{ .a .b }}"])
def test_bad_templates(spark, text):
    with pytest.raises(QueryError):
        logql.template(text, F.create_map(F.lit("a"), F.lit("b")), F.lit("line"))


def test_deletion_takes_all_alternatives(spark):
    logs = table(spark, ["one a", "two b", "three c", "four d"])
    left = log_analytics.without_deleted(logs, [('{app="x"} |= "a" or "b"', 0, 10**18)])
    assert sorted(r.line for r in left.collect()) == ["four d", "three c"]
    left = log_analytics.without_deleted(logs, [('{app="x"} != "a" or "b"', 0, 10**18)])
    assert sorted(r.line for r in left.collect()) == ["one a", "two b"]
    left = log_analytics.without_deleted(logs, [('{app="x"} |= "a"', 2 * SECOND, 10**18)])
    assert left.count() == 4


PATTERNS = {
    "took 12ms user=7 id=abc done": "took <_> user=<_> id=abc done", "req 0123456789abcdef0123 deadbeef Abcdefgh12345678 abcdefghijklmnopqrst": "req <_> deadbeef <_> abcdefghijklmnopqrst",
    "6ba7b810-9dad-11d1-80b4-00c04fd430c8 x=6ba7b810-9dad-11d1-80b4-00c04fd430c8 -5 +1.5e3 -5a inf =3 k=": "<_> x=<_> <_> <_> -5a <_> =3 k=", 'a  "17"  b="9x" c=d=5': '<_>'.join(["a ", ' b=', " c=d=5"]),
    '{"a": 1, "msg" : "got 15 of x", "ok":true, "n":null, "list":[1, "two", {"z":-2.5e3}]}': '{"a":"<_>","msg":"got <_> of x","ok":true,"n":null,"list":["<_>","two",{"z":"<_>"}]}', "{broken 5": "{broken <_>",
}


def test_patterns(spark):
    logs = table(spark, [*PATTERNS])
    got = {r.pattern for r in log_analytics.patterns(logs, 1000).collect()}
    assert got == set(PATTERNS.values())
