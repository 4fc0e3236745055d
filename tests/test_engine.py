import http.server
import json
import threading
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry import cli
from quarry.config import ExtractConfig, MultiPassConfig
from quarry.functions.register import register
from quarry.operators.aggregate import pass_stats
from quarry.operators.infer import infer, replayed, resumed, with_keys
from quarry.plans import pipeline, prompts
from quarry.plans.engine import Spec, extract, extract_text
from quarry.schema import ConfigurationError, Example, Extraction, InferenceError, PipelineError, TemplateError, answer_schema, violations
from quarry.sinks import export
from quarry.sources import readers
from quarry.sources.models import CallableModel, HttpModel, InferenceConfig, ProviderConfig, ReplayModel, RuleModel, Scored, make_model, parse_env, with_retries
from quarry.streaming.documents import extract_stream, once

SPEC = Spec("Find numbers", (Example("Call 12", (Extraction("number", "12"),)),))
RULES = RuleModel({"number": "[0-9]+", "name": "[A-Z][a-z]+"})


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_templates():
    assert prompts.render("a {x} b {y}", {"x": "{y}"}) == "a {y} b "
    assert prompts.variables("{b} {a} {b}") == ["b", "a"]
    with pytest.raises(TemplateError):
        prompts.render("{x", {})
    with pytest.raises(TemplateError):
        prompts.render("{x}", {}, strict=True)
    with pytest.raises(TemplateError):
        prompts.validate("{task_description}")
    t = prompts.PromptTemplate.for_provider("ollama", "D", SPEC.examples)
    assert t.max_examples == 3 and "Work in steps" in t.render("T") and "Additional Context: C" in t.render("T", "C")
    assert "number: " in prompts.format_examples(list(SPEC.examples), "yaml") and prompts.format_examples([]) == ""


def test_prompt_column_equals_render(spark):
    t = prompts.PromptTemplate("D {x}", SPEC.examples)
    d = docs(spark, "a {y} b").withColumn("c", F.lit("more"))
    assert d.select(t.column(F.col("text"), F.col("c")).alias("p")).first().p == t.render("a {y} b", "more")


def test_extract(spark):
    r = extract(docs(spark, "Ann has 3 pens", "", None, "x" * 30 + " Bob 77. " * 20), SPEC, ExtractConfig(RULES, max_char_buffer=60))
    got = [(x.doc_id, x.extraction_class, x.extraction_text, x.start_pos, x.alignment_status) for x in r.extractions.orderBy("doc_id", "chunk_id", "ordinal").collect()]
    assert got[:2] == [(0, "name", "Ann", 0, "match_exact"), (0, "number", "3", 8, "match_exact")]
    assert [g[1:4] for g in got[2:]] == [("name", "Bob", 31), ("number", "77", 35)]
    assert r.responses.filter("success").count() == r.responses.count()
    with pytest.raises(ConfigurationError):
        Spec("x", ())
    assert extract_text(spark, "7", SPEC, ExtractConfig(RULES)).extractions.first().coerced.long_value == 7


def test_failures_stay_in_their_rows(spark):
    def call(p):
        if "bad" in p[p.rfind("Input: ") :]:
            raise InferenceError("no")
        return '{"a": "1"}'

    r = extract(docs(spark, "good", "bad"), SPEC, ExtractConfig(CallableModel(call)))
    assert {(x.doc_id, x.success, x.error) for x in r.responses.collect()} == {(0, True, None), (1, False, "no")}
    assert [x.doc_id for x in r.extractions.collect()] == [0]


class Growing:
    """Tells one more word each time it is told what was found."""

    def infer(self, prompts_, config):
        out = []
        for p in prompts_:
            words = p[p.rfind("\n\nInput: ") + 9 : p.rfind("\n\nOutput (")].split()
            told = p.count("\n- ")
            out.append([Scored(json.dumps({f"c{i}": w for i, w in enumerate(words[: told + 1])}))])
        return out


def test_multipass(spark):
    r = extract(docs(spark, "alpha beta gamma", "delta", "1"), SPEC, ExtractConfig(Growing(), multipass=MultiPassConfig(5)))
    assert {(x.doc_id, x.extraction_text, x.pass_number) for x in r.extractions.collect()} == {(0, "alpha", 1), (0, "beta", 2), (0, "gamma", 3), (1, "delta", 1), (2, "1", 1)}
    assert r.responses.groupBy("doc_id").count().orderBy("doc_id").collect()[0]["count"] == 4
    stats = {(x.doc_id, x.pass_number): x.new for x in pass_stats(r.responses, r.extractions).collect()}
    assert stats == {(0, 1): 1, (0, 2): 1, (0, 3): 1, (0, 4): 0, (1, 1): 1, (1, 2): 0, (2, 1): 1, (2, 2): 0}


def test_multipass_asks_again_where_little_was_found(spark):
    from quarry.operators.chunks import ChunkConfig

    text = "Ann. " + "x" * 40 + ". " + "y" * 40 + "."
    r = extract(docs(spark, text), SPEC, ExtractConfig(RULES, max_char_buffer=20, chunking=ChunkConfig("sentence", 45, 0, 1), multipass=MultiPassConfig(2)))
    by = {x.pass_number: x.n for x in r.responses.groupBy("pass_number").agg(F.count("*").alias("n")).collect()}
    assert by[2] == by[1] - 1


def test_pipeline(spark):
    p = pipeline.from_dict(
        {
            "name": "p",
            "steps": [
                {"id": "b", "prompt": "x", "examples": [{"text": "a", "extractions": [{"extraction_class": "number", "extraction_text": "1"}]}], "depends_on": ["a"], "filter": {"class_filter": "line", "max_items": 2}},
                {"id": "a", "prompt": "x", "examples": [{"text": "a", "extractions": [{"extraction_class": "line", "extraction_text": "1"}]}]},
            ],
        }
    )
    assert p.order() == ["a", "b"] and p.waves() == [["a"], ["b"]]
    model = RuleModel({"line": r"\w+ shall \d+", "number": r"\d+"})
    r = pipeline.execute(docs(spark, "pumps shall 40. fans shall 7. ducts shall 9.", "none"), p, ExtractConfig(model))
    rows = r.steps["b"].filter("extraction_class = 'number'").orderBy("start_pos").collect()
    assert [(x.extraction_text, x.start_pos, x.end_pos, x.parent_step_id, x.parent_text) for x in rows] == [("40", 12, 14, "a", "pumps shall 40"), ("7", 27, 28, "a", "fans shall 7")]
    said = json.loads(pipeline.nested_output(r).filter("doc_id = 0").first().output)
    assert list(said) == ["a", "b"] and said["b"]["count"] == len(said["b"]["extractions"])
    assert pipeline.from_dict(__import__("yaml").safe_load(pipeline.dump(pipeline.sample()))) == pipeline.sample()
    assert pipeline.sample().waves()[1] == ["extract_values", "extract_specifications"]
    step = pipeline.Step
    with pytest.raises(PipelineError, match="Circular"):
        pipeline.Pipeline("x", (step("a", "", depends_on=("b",)), step("b", "", depends_on=("a",)))).order()
    with pytest.raises(PipelineError, match="waves"):
        pipeline.Pipeline("x", (step("a", "", depends_on=("q",)),)).waves()


def test_exports(spark):
    d = docs(spark, "John Smith at TechCorp earns $50,000 <b>", "empty")
    f = "doc_id long, ordinal int, extraction_class string, extraction_text string, start_pos bigint, end_pos bigint, alignment_status string, group_index int"
    rows = spark.createDataFrame([(0, 0, "person", "John Smith", 0, 10, "match_exact", None), (0, 1, "org", "TechCorp", 14, 22, "match_exact", 1), (0, 2, "x", "Smith at", 5, 13, None, None)], f)
    got = {k: {r.doc_id: r.report for r in export.reports(d, rows, export.ExportConfig(k, title="<T>")).collect()} for k in export.FORMATS}
    assert "<mark" in got["html"][0] and "&lt;b&gt;" in got["html"][0] and "<title>&lt;T&gt;" in got["html"][0] and "Smith</mark>" in got["html"][0]
    assert "**John Smith** at **TechCorp**" in got["markdown"][0] and "3 values in" in got["text"][0] and "0 values in" in got["text"][1]
    assert len(got["csv"][0].strip().split("\n")) == 4 and json.loads(got["json"][0])["statistics"]["unique_classes"] == 3 and json.loads(got["json"][1])["extractions"] == []
    assert __import__("yaml").safe_load(got["yaml"][0])["extractions"][1]["group_index"] == 1
    layers = export.layered("abcdef", [{"start_pos": 0, "end_pos": 4, "extraction_class": "p"}, {"start_pos": 2, "end_pos": 6, "extraction_class": "q"}])
    assert __import__("re").sub("<[^>]+>", "", layers) == "abcdef" and "layers-2" in layers


class Handler(http.server.BaseHTTPRequestHandler):
    seen: list = []
    fail = 0

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Handler.seen.append((self.path, body, self.headers.get("Authorization")))
        if Handler.fail:
            Handler.fail -= 1
            self.send_response(503)
            self.end_headers()
            return
        said = {"response": '{"a": 1}'} if self.path == "/api/generate" else {"choices": [{"message": {"content": '{"b": 2}'}}]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(said).encode())

    def do_GET(self):
        self.send_response(200 if self.path == "/ok" else 404)
        self.end_headers()
        self.wfile.write(b"<p>page</p>")

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_raw_answers(spark, tmp_path):
    r = extract(docs(spark, "Ann 3"), SPEC, ExtractConfig(RULES))
    export.write_raw(r.responses, str(tmp_path / "raw"), "one")
    assert spark.read.parquet(str(tmp_path / "raw")).first().run_id == "one"
    export.write_text(docs(spark, "a", "b").coalesce(1), str(tmp_path / "t"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "t")).collect()) == ["a", "b"]


def test_http(server, spark):
    m = HttpModel(ProviderConfig.ollama("m", server), wait=0)
    assert m.infer(["p"], InferenceConfig(2.0, 9))[0][0].text == '{"a": 1}'
    assert Handler.seen[-1][1]["options"] == {"temperature": 1.0, "num_predict": 9}
    Handler.fail = 2
    m = HttpModel(ProviderConfig.compatible("m", server, "k"), wait=0)
    assert m.infer(["p"], InferenceConfig())[0][0].text == '{"b": 2}'
    assert Handler.seen[-1][2] == "Bearer k"
    Handler.fail = 9
    with pytest.raises(InferenceError):
        HttpModel(ProviderConfig.custom("m", server), attempts=2, wait=0).infer(["p"], InferenceConfig())
    Handler.fail = 0
    got = readers.urls(spark.createDataFrame([(f"{server}/ok",), (f"{server}/no",), ("x",), (None,)], "url string")).collect()
    assert got[0].text == "<p>page</p>" and [bool(r.error) for r in got] == [False, True, True, True]


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        raise InferenceError("x", transient=len(calls) < 3)

    with pytest.raises(InferenceError):
        with_retries(call, 4, 30, waits.append)
    assert waits == [30, 60]


def test_models(spark):
    with pytest.raises(ConfigurationError):
        make_model(None)
    with pytest.raises(InferenceError):
        ReplayModel({}).infer(["x"], InferenceConfig())
    p = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, None)], "doc_id long, chunk_id int, prompt string")
    stored = with_keys(p.filter("doc_id = 1")).withColumn("response", F.lit("old"))
    got = {r.doc_id: (r.response, r.success) for r in replayed(p, stored, CallableModel(str.upper)).collect()}
    assert got == {1: ("old", True), 2: ("B", True), 3: (None, False)}
    assert infer(p, CallableModel(str.upper), partitions=2).count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld")
    (tmp_path / "e.yaml").write_text("- text: t\n  extractions:\n  - {extraction_class: a, extraction_text: b}\n")
    assert readers.text_files(spark, str(tmp_path / "a.txt")).first().text == "hello\nworld"
    assert readers.resolve(spark, str(tmp_path / "a.txt")).first().text == "hello\nworld" and readers.resolve(spark, "just text").first().text == "just text"
    assert readers.resolve(spark, f"file://{tmp_path}/a.txt").first().text == "hello\nworld" and [readers.exists(spark, x) for x in ("", "gs://no/such", "a: b", str(tmp_path))] == [False, False, False, True]
    assert readers.load_examples(spark, str(tmp_path / "e.yaml"))[0].extractions[0].extraction_text == "b"
    (tmp_path / "r.json").write_text(json.dumps({"document_id": "d", "text": "ab", "extractions": [{"extraction_class": "c", "extraction_text": "a", "char_interval": {"start_pos": 0, "end_pos": 1}}]}))
    assert readers.annotated_rows(readers.annotated(spark, str(tmp_path / "r.json"))).first().end_pos == 1
    assert parse_env(["# x", "A=1", "export B='2'", ""]) == {"A": "1", "B": "2"}


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["providers"]) == 0 and cli.main(["examples"]) == 0
    assert cli.main(["init", "--folder", str(tmp_path)]) == 0 and cli.main(["init", "--folder", str(tmp_path)]) == 1
    assert cli.main(["extract", "Ann is 31", "--prompt", "p", "--provider", "rules", "--rule", "number=[0-9]+", "--export", "csv"]) == 0
    assert "number,31,,7,9,match_exact," in capsys.readouterr().out
    assert cli.main(["pipeline", str(tmp_path / "pipeline.yaml"), "The pump shall deliver 40 litres.", "--provider", "rules", "--rule", "requirement=The.*", "--rule", "numeric_value=[0-9]+"]) == 0
    assert "numeric_value" in capsys.readouterr().out


def test_sql_functions(spark):
    assert "quarry_tokenize" in register(spark)
    assert spark.sql("select size(quarry_tokenize('a b!')) n").first().n == 3
    assert [r.text for r in spark.sql("select * from quarry_chunk('One two. Three four.', 9)").collect()] == ["One two.", "Three", "four."]
    assert spark.sql("select quarry_align_fuzzy('John Smith', 'Hello, John is named Smith.') x").first().x.start_pos is not None
    assert spark.sql("""select * from quarry_json_leaves('{"a": ["x"]}')""").first().path == "a:[0]"
    assert spark.sql("""select quarry_parse_response('{"a": 1}') x""").first().x[0].extraction_text == "1"


def test_short_texts_are_tokenised_together(spark, monkeypatch):
    """One scan for a batch of short texts, with the tokens of each alone; nulls and empty texts have none."""
    from quarry.operators import tokens as T

    texts = ["a b!", None, "", "Dr. Who 12/5", "é x"] * 400
    want = [[(x.text, x.kind, x.start, x.end) for x in T.tokenize(t)] for t in texts]
    scans, scan = [], T.scan
    monkeypatch.setattr(T, "scan", lambda texts: scans.append(1) or scan(texts))
    assert [[tuple(x.values()) for x in row] for row in T.listed(pa.array(texts)).to_pylist()] == want and len(scans) == 1
    assert len(T.listed(pa.array([], pa.string()))) == 0
    register(spark)
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: [tuple(x) for x in r.x] for r in d.selectExpr("i", "quarry_tokenize(t) x").collect()}
    assert got == dict(enumerate(want))
    assert [len(r.x) for r in spark.sql("select quarry_parse_response(t) x from values ('[1'), (null), ('{}') v(t)").collect()] == [1, 0, 0]


def test_stream(spark, tmp_path):
    d = docs(spark, "Ann 3", "Bob").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    d.unionByName(d).write.parquet(str(tmp_path / "in"))
    s = once(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")))
    q = extract_stream(s, SPEC, ExtractConfig(RULES), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.extraction_text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["3", "Ann", "Bob"]


def test_null_and_repeated_ids_stay_apart(spark):
    d = spark.createDataFrame([(None, "n 11"), (None, "n 22"), (5, "n 33"), (5, "n 44")], "doc_id long, text string")
    one = (Example("1", (Extraction("number", "1"),)),)
    p = pipeline.Pipeline("p", (pipeline.Step("a", "x", one), pipeline.Step("b", "x", one, depends_on=("a",)), pipeline.Step("c", "x", one, filter=pipeline.Filter(text_pattern="(?<=[3])"), depends_on=("a",))), parallel=True)
    r = pipeline.execute(d, p, ExtractConfig(RuleModel({"number": "[0-9]+"})))
    for step, want in (("a", ["11", "22", "33", "44"]), ("b", ["11", "22", "33", "44"]), ("c", ["33"])):
        assert sorted(x.extraction_text for x in r.steps[step].collect()) == want
    assert list(r.names) == ["a", "b", "c"]


def test_pipeline_settings_and_events(spark):
    from quarry.config import from_settings

    base = ExtractConfig(ProviderConfig.openai("m"))
    c = from_settings({"model_id": "n", "max_char_buffer": 9, "temperature": 0.1, "format_type": "yaml", "enable_multipass": True, "multipass_max_passes": 4, "use_schema_constraints": True, "api_key": None}, base)
    assert (c.model.model, c.max_char_buffer, c.inference.temperature, c.format, c.multipass.passes, c.model.constrained) == ("n", 9, 0.1, "yaml", 4, True)
    assert not c.model.expects_fence("json") and c.model.expects_fence("yaml") and ProviderConfig.ollama("m").expects_fence("json")
    with pytest.raises(ConfigurationError, match="wrong_name"):
        from_settings({"wrong_name": 1}, base)
    seen = []
    one = (Example("1", (Extraction("number", "1"),)),)
    p = pipeline.Pipeline("p", (pipeline.Step("a", "x", one),), config={"max_char_buffer": 30})
    r = pipeline.execute(docs(spark, "x" * 28 + ". 12. " + "y" * 20), p, ExtractConfig(RuleModel({"number": "[0-9]+"})), on_event=seen.append)
    assert {x.chunk_id for x in r.rows().collect()} == {1}
    assert [e.kind for e in seen if e.kind.startswith("step")] == ["step_started", "step_finished"] and next(e for e in seen if e.kind == "answered").values["chunks"] >= 2


def test_raw_folder_and_least_quality(spark, tmp_path):
    from quarry.operators.validate import ValidationConfig

    c = ExtractConfig(RULES, validation=ValidationConfig(raw_folder=str(tmp_path / "raw"), quality=0.9))
    r = extract(docs(spark, "Ann has 3 pens"), SPEC, c)
    assert [x.extraction_text for x in r.extractions.collect()] == ["Ann"] and spark.read.parquet(str(tmp_path / "raw")).count() == 1


def test_convert_reads_its_own_export(spark, tmp_path, capsys):
    assert cli.main(["extract", "Ann is 31", "--prompt", "p", "--provider", "rules", "--rule", "number=[0-9]+", "--export", "json", "--output", str(tmp_path / "e")]) == 0
    assert cli.main(["convert", str(tmp_path / "e"), "--export", "csv"]) == 0
    assert "number,31,,7,9,match_exact," in capsys.readouterr().out


def test_constrained_answers(server):
    HttpModel(ProviderConfig("openai", "m", server, constrained=True), wait=0).infer(["p"], InferenceConfig())
    assert Handler.seen[-1][1]["response_format"] == {"type": "json_object"}


class Told:
    """Gives back the context that it is told, and one more value when it is told what was found."""

    def infer(self, prompts_, config):
        out = []
        for p in prompts_:
            said = p.partition("Additional Context: ")[2].partition("\n")[0]
            out.append([Scored(json.dumps({"said": said} | ({"more": "again"} if p.count("\n- ") else {})))])
        return out


@pytest.mark.parametrize("multipass", [None, MultiPassConfig(3, refinement=False), MultiPassConfig(2)])
def test_contexts_and_ids_that_are_null_or_repeated(spark, multipass):
    rows = [(1, "n 11", "told a"), (1, "n 22", "told b"), (None, "n 33", "told c"), (None, "n 44. " * 30, "told d"), (2, "n 55", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, additional_context string")
    r = extract(d, SPEC, ExtractConfig(Told(), context="all", max_char_buffer=100, multipass=multipass))
    first = r.extractions.filter("extraction_class = 'said' and pass_number = 1")
    assert sorted((str(x.doc_id), x.extraction_text) for x in first.collect()) == [("1", "told a"), ("1", "told b"), ("2", "all"), ("None", "told c"), ("None", "told d")]
    assert "doc_key" not in r.extractions.columns + r.responses.columns
    if multipass:
        again = {(str(x.doc_id), x.pass_number) for x in r.responses.collect()}
        assert {("1", 2), ("2", 2), ("None", 2)} <= again  # none is left out for its id
        if multipass.refinement:
            more = r.extractions.filter("extraction_class = 'more'")
            # the long text's chunk gave enough, so that only texts in one piece are asked again
            assert sorted(str(x.doc_id) for x in more.collect()) == ["1", "1", "2", "None"]


class Busy(http.server.BaseHTTPRequestHandler):
    """A slow chat server that counts how many requests are open, and what it was asked."""

    lock = threading.Lock()
    now = most = 0
    asked: list = []
    bodies: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        said = body["messages"][1]["content"]
        with Busy.lock:
            Busy.now += 1
            Busy.most = max(Busy.most, Busy.now)
            Busy.asked.append(said)
            Busy.bodies.append(body)
        threading.Event().wait(0.5 if "slow" in said else 0.01)
        with Busy.lock:
            Busy.now -= 1
            again = "flaky" in said and Busy.asked.count(said) < 3
        self.send_response(503 if again else 200)
        self.end_headers()
        text = said[said.rfind("Input: ") + 7 :].partition("\n")[0]
        answer = {"data": [{"number": "12"}]} if "right" in text else {"data": [{"colour": 1}]} if "wrong" in text else {"v": text}
        self.wfile.write(b"" if again else json.dumps({"choices": [{"message": {"content": json.dumps(answer)}}]}).encode())

    def log_message(self, *a):
        pass


@pytest.fixture
def busy():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Busy)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Busy.now, Busy.most, Busy.asked, Busy.bodies = 0, 0, [], []
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_window_of_open_requests(spark, busy):
    texts = [f"Input: {'slow' if i in (0, 30) else 'flaky' if i == 5 else 'p'}{i}" for i in range(60)] + [None]
    p = spark.createDataFrame(list(enumerate(texts)), "doc_id long, prompt string").coalesce(1)
    got = infer(p, HttpModel(ProviderConfig.compatible("m", busy), wait=0, workers=6), batch=4).collect()
    assert [r.doc_id for r in got] == list(range(61)) and [r.success for r in got] == [True] * 60 + [False]
    assert [json.loads(r.response)["v"] for r in got[:60]] == [t[7:] for t in texts[:60]]
    assert Busy.most <= 6 and Busy.most > 2
    assert len(Busy.asked) == 62 and [r.retries for r in got if r.retries] == [2]  # only the flaky one is asked again
    assert got[1].latency_ms < 400 <= got[0].latency_ms  # others do not wait for a slow one


def test_one_failure_asks_nobody_again(spark, tmp_path):
    log = tmp_path / "asked"

    def call(p):
        with open(log, "a") as f:
            f.write(p + "\n")
        if p == "b":
            raise InferenceError("no")
        return p

    p = spark.createDataFrame([(i, t) for i, t in enumerate("abcde")], "doc_id long, prompt string").coalesce(1)
    assert [(r.success, r.error) for r in infer(p, CallableModel(call)).collect()] == [(True, None), (False, "no")] + [(True, None)] * 3
    assert log.read_text().split() == list("abcde")


def test_answers_outlive_a_job_that_is_lost(spark, tmp_path):
    log, store = tmp_path / "asked", str(tmp_path / "answers")

    def call(p, dies):
        if dies and p == "p7":
            raise MemoryError("lost")
        with open(log, "a") as f:
            f.write(p + "\n")
        if p == "p3" and dies:
            raise InferenceError("not now")
        return p.upper()

    rows = [(i, f"p{i % 12}") for i in range(30)] + [(30, None)]
    p = spark.createDataFrame(rows, "doc_id long, prompt string").repartition(3)
    with pytest.raises(Exception, match="lost"):
        resumed(p, CallableModel(lambda t: call(t, True)), store, per_task=1)
    before = log.read_text().split()
    assert 0 < len(before) < 12 and len(set(before)) == len(before)
    got = {r.doc_id: (r.response, r.success) for r in resumed(p, CallableModel(lambda t: call(t, False)), store, per_task=1).collect()}
    assert got == {i: (t.upper(), True) if t else (None, False) for i, t in rows}
    after = log.read_text().split()
    kept = {r.response for r in spark.read.parquet(store).filter("success").collect()}
    assert kept == {f"P{i}" for i in range(12)} and after.count("p7") == 1
    # what had been written was not asked again; the failed prompt was
    assert len(after) - len(before) < 12 and (before.count("p3") == 0 or after.count("p3") == 2)
    resumed(p, CallableModel(lambda t: call(t, False)), store).collect()
    assert log.read_text().split() == after
    c = ExtractConfig(RULES, answers=str(tmp_path / "more"))
    one = extract(docs(spark, "Ann 3", "Ann 3", "Bob 4"), SPEC, c)
    assert spark.read.parquet(c.answers).count() == 2 and one.extractions.count() == 6
    assert extract(docs(spark, "Ann 3", "Cid 5"), SPEC, c).extractions.count() == 4 and spark.read.parquet(c.answers).count() == 3


def test_schema_from_examples():
    made = answer_schema([Example("x", (Extraction("n", "12"), Extraction("r", "0.5"), Extraction("s", "a"), Extraction("b", "true"))), Example("y", (Extraction("r", "3"), Extraction("s", "7")))])
    item = made["properties"]["data"]["items"]
    assert item["properties"] == {"b": {"type": ["string", "boolean", "null"]}, "n": {"type": ["string", "integer", "null"]}, "r": {"type": ["string", "number", "null"]}, "s": {"type": ["string", "null"]}}
    assert item["required"] == ["b", "n", "r", "s"] and item["additionalProperties"] is False
    fine = {"data": [{"b": None, "n": 3, "r": 2, "s": "x"}, {"b": "true", "n": "3", "r": 0.5, "s": None}]}
    assert violations(fine, made) == []
    assert violations({"data": [{"b": None, "n": 3.5, "r": 1, "s": "x", "z": 0}]}, made) == ["answer.data[0] has the unknown key z", "answer.data[0].n is number, not string or integer or null"]
    assert violations([], made) == ["answer is array, not object"] and violations({}, made) == ["answer lacks data"]


def test_constrained_answers_are_held_to_the_schema(spark, busy):
    c = ExtractConfig(replace(ProviderConfig.compatible("m", busy), constrained=True), workers=2)
    r = extract(docs(spark, "right", "wrong", "other"), SPEC, c)
    held = Busy.bodies[0]["response_format"]
    assert held["type"] == "json_schema" and held["json_schema"]["strict"] and held["json_schema"]["schema"] == answer_schema(list(SPEC.examples))
    assert "```" not in Busy.asked[0]  # a server that is held to a schema is not asked for a fence
    got = {x.doc_id: x.invalid for x in r.responses.collect()}
    assert got[0] is None and "lacks number" in got[1] and "unknown key colour" in got[1] and "lacks data" in got[2]
    extract(docs(spark, "right"), SPEC, replace(c, model=replace(c.model, constrained=False)))
    assert "Put it between ```json and ```" in Busy.asked[-1] and "response_format" not in Busy.bodies[-1]


def test_events_of_a_failing_provider(spark, busy):
    seen = []
    model = HttpModel(ProviderConfig.compatible("m", busy), wait=0, workers=3)
    r = extract(docs(spark, "flaky", "right"), SPEC, ExtractConfig(model), on_event=seen.append)
    by = {e.kind: e.values for e in seen}
    assert by["answered"]["chunks"] == 2 and by["answered"]["failed"] == 0
    assert by["retried"] == {"number": 1, "retries": 2} and sorted(x.retries for x in r.responses.collect()) == [0, 2]
    debug = [e.values for e in seen if e.kind == "debug"]
    (told,) = (v for v in debug if v.get("operator") == "infer")
    assert told["rows"] == 2 and told["latency_ms_95"] >= told["latency_ms_median"] and told["prompt_chars"] > 100
    assert {"infer, pass 1", "similar values"} <= {v.get("span") for v in debug} and all(v["took_ms"] >= 0 for v in debug if "span" in v)


def test_passes_over_whole_documents_ground_once_and_hand_back_no_prompts(spark, monkeypatch):
    """Values of documents in one piece are not placed again to count them, and prompts stay in the task that asks."""
    from quarry.functions.text import first_words, split_words
    from quarry.plans import engine

    asked, whole = [], engine.infer
    monkeypatch.setattr(engine, "infer", lambda *a, **k: asked.append(whole(*a, **k)) or asked[-1])
    placed, ground = [], engine._grounded
    monkeypatch.setattr(engine, "_grounded", lambda r, *a: placed.append(r) or ground(r, *a))
    d = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, "")], "doc_id long, text string")
    rule = RuleModel({"w": "[a-z]+"})
    r = extract(d, Spec("d", (Example("x", (Extraction("w", "x"),)),)), ExtractConfig(rule, multipass=MultiPassConfig(2)))
    assert {(x.doc_id, x.extraction_text) for x in r.extractions.collect()} == {(1, "one"), (1, "two"), (1, "three"), (2, "four")}
    assert asked and all("prompt" not in x.columns and "context" not in x.columns for x in asked)
    assert placed[1].count() == 0 and placed[0].count() == 2
    for t in (None, "", " \t", "a", " a  b\u00a0c\nd ", "é\x1cx y"):
        assert [first_words(t, n) for n in (0, 1, 2, 9)] == [split_words(t)[:n] for n in (0, 1, 2, 9)]
