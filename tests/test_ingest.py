import json

import pytest
from pyspark.sql import functions as F

from logloom.functions import pricing
from logloom.plans import denials as dn, search as sr, threads as th, trace as trc, usage as us, waits
from logloom.schemas import Corpus
from logloom.sources import refresh as rf, side_files as sd, transcripts as tr, wells as wl

USAGE = {"input_tokens": 10, "cache_creation_input_tokens": 100, "cache_read_input_tokens": 1000, "output_tokens": 5, "cache_creation": {"ephemeral_1h_input_tokens": 100}}


def at(n):
    return f"2026-09-02T06:{n // 60:02d}:{n % 60:02d}Z"


def user(n, content, **kw):
    return {"type": "user", "timestamp": at(n), "sessionId": "s1", "cwd": "/u/code/app", "message": {"role": "user", "content": content}, **kw}


RATES = [("claude-fable-5-1", "2026-09-01", 10.0, 12.5, 20.0, 0.25, 50.0), ("claude-fable-5", "2026-01-01", 10.0, 12.5, 20.0, 1.0, 50.0),
         ("claude-opus-4-8", "2026-01-01", 5.0, 6.25, 10.0, 0.5, 25.0), ("claude-opus-4", "2025-01-01", 15.0, 18.75, 30.0, 1.5, 75.0)]


def reply(n, mid, block, out=5, stop=None, model="claude-opus-5", **kw):
    return {"type": "assistant", "timestamp": at(n), "sessionId": "s1", "message": {"id": mid, "model": model, "role": "assistant", "stop_reason": stop, "content": [block], "usage": {**USAGE, "output_tokens": out}}, **kw}


def call(tid, name, **kw):
    return {"type": "tool_use", "id": tid, "name": name, "input": kw}


def result(tid, content, **kw):
    return {"type": "tool_result", "tool_use_id": tid, "content": content, **kw}


SESSION = [
    {"type": "bridge-session", "timestamp": at(0), "sessionId": "s1", "bridgeSessionId": "cse_AB"},
    user(1, "fix it", promptId="P1", session_id="root"),
    reply(2, "m1", {"type": "thinking", "thinking": "hmm"}, out=1),
    reply(3, "m1", {"type": "text", "text": "Looking."}, out=3),
    reply(4, "m1", call("t1", "Bash", command="pytest -q"), out=9, stop="tool_use"),
    user(6, [result("t1", "2 failed, 3 passed", is_error=True)]),
    reply(7, "m2", call("t2", "Skill", skill="design"), stop=None),
    user(8, [result("t2", [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}])]),
    user(9, "<command-name>/clear</command-name>", isMeta=True),
    {"type": "attachment", "timestamp": at(10), "sessionId": "s1", "attachment": {"type": "queued_command", "prompt": [{"type": "text", "text": "also this"}, {"type": "image"}]}},
    {"type": "attachment", "timestamp": at(11), "sessionId": "s1", "attachment": {"type": "queued_command", "prompt": "   "}},
    {"type": "attachment", "timestamp": at(12), "sessionId": "s1", "attachment": {"type": "auto_mode", "bashFirst": True}},
    user(13, "hello from ann", origin={"kind": "peer", "name": "ann", "msg_id": "m-1"}),
    user(14, "report", origin={"kind": "peer", "name": "lean", "handback": True}),
    reply(15, "x", {"type": "text", "text": "limit"}, model="<synthetic>", apiError="usage_limit_reached", apiErrorParams={"rate_limit_info": {"rateLimitType": "seven_day", "resetsAt": 1794654000}}),
    {"type": "system", "subtype": "away_summary", "timestamp": at(16), "sessionId": "s1", "content": "z" * 3000},
    {"type": "system", "subtype": "note", "timestamp": at(17), "sessionId": "s1", "content": "z" * 3000},
    {"type": "pr-link", "timestamp": at(18), "sessionId": "s1", "prRepository": "a/b", "prNumber": 7, "prUrl": "http://x"},
    {"type": "summary", "summary": "done"},
    {"type": "mode", "timestamp": at(19), "sessionId": "s1"},
]
SPAWN = [
    {"type": "user", "timestamp": at(1), "message": {"role": "user", "content": "go"}},
    reply(2, "q1", {"type": "text", "text": "a"}, out=2), reply(3, "q1", call("u1", "Read", file_path="/x"), out=7, stop="tool_use"),
    user(4, [result("u1", "ok")]), reply(5, "q2", call("u2", "SubagentHandback"), out=4, stop="tool_use"),
    user(6, [result("u2", "sent")], toolUseResult={"success": True}),
]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("logs")
    well = base / "-u-code-app"
    (well / "s1" / "subagents" / "workflows" / "wf_9").mkdir(parents=True)
    (well / "memory").mkdir()
    (well / "memory" / "m.md").write_text("x")
    (well / "s1.jsonl").write_text("\n".join(json.dumps(r, separators=(",", ":")) for r in SESSION) + '\n\n{"type":"user","mess')
    sub = well / "s1" / "subagents"
    dump = lambda rs: "\n".join(json.dumps(r, separators=(",", ":")) for r in rs)
    (sub / "agent-a1.jsonl").write_text(dump(SPAWN))
    (sub / "agent-a1.meta.json").write_text('{"agentType":"lean","model":"opus"}')
    (sub / "agent-a2.jsonl").write_text(dump(SPAWN[:-1] + [user(6, [result("u2", "no")], toolUseResult={"success": False})]))
    (sub / "agent-a3.jsonl").write_text(dump(SPAWN + [reply(7, "q3", {"type": "text", "text": "resumed"}, stop="end_turn")]))
    (sub / "workflows" / "wf_9" / "agent-a4.jsonl").write_text(dump([reply(1, "z", {"type": "text", "text": "no"}, model="<synthetic>", stop="stop_sequence")]))
    return str(base)


def test_session_log_to_tables(spark, root):
    c = rf.index_sessions(spark, root)
    got = [(r.lane, r.type, r.tool_name, r.prompt_id, r.request_id, r.peer, r.msg_id) for r in c.messages.orderBy("line_no", "pos").collect()]
    P = "P1"
    assert got == [
        ("prompt", "user", None, P, None, None, None), ("thinking", "assistant", None, P, "m1", None, None), ("text", "assistant", None, P, "m1", None, None),
        ("tool", "assistant", "Bash", P, "m1", None, None), ("tool", "user", None, P, None, None, None), ("tool", "assistant", "Skill:design", P, "m2", None, None),
        ("tool", "user", None, P, None, None, None), ("meta", "user", "command:clear", P, None, None, None), ("prompt", "attachment", None, P, None, None, None),
        ("event", "attachment", None, P, None, None, None), ("relay", "user", None, P, None, "ann", "m-1"), ("relay", "user", None, P, None, None, None),
        ("text", "assistant", None, P, None, None, None), ("event", "system", None, P, None, None, None), ("event", "system", None, P, None, None, None),
        ("event", "pr-link", None, P, None, None, None), ("event", "summary", None, P, None, None, None)]
    text = {r.line_no: r.text for r in c.messages.collect()}
    assert text[5] == 'Bash {"command":"pytest -q"}' and text[8] == "a\nb" and text[10] == "also this"
    assert len(text[16]) == len("away_summary: ") + 3000 and len(text[17]) == 2000
    assert text[12] == 'auto_mode: {"bashFirst":true,"bashFirstSteer":null,"steerOnly":null,"bypass":null}' and text[18] == "pr-link: a/b#7 http://x"
    s = c.sessions.first()
    assert (s.lines, s.job_session_id, s.bridge_key, s.well) == (20, "root", "AB", "-u-code-app")
    assert [t.strftime("%M:%S") for t in (s.first_ts, s.last_ts, s.last_activity_ts)] == ["00:00", "00:19", "00:15"]
    reqs = {r.message_id: r for r in c.requests.collect()}
    assert set(reqs) == {"m1", "m2"} and reqs["m1"].output_tokens == 9 and reqs["m1"].stop_reason == "tool_use" and reqs["m2"].stop_reason is None
    assert reqs["m1"].ts.strftime("%S") == "02"
    lim = c.limits.first()
    assert (lim.kind, lim.pct, lim.source) == ("seven_day", 100.0, "transcript")


def test_result_does_not_depend_on_partitioning(spark, root):
    lines = tr.session_lines(tr.read_lines(spark, root))
    base = rf.index_sessions(spark, root, lines).messages
    again = rf.index_sessions(spark, root, lines.repartition(5)).messages
    assert base.exceptAll(again).count() == 0 and again.exceptAll(base).count() == 0


def test_sub_agents(spark, root):
    recs = tr.spawn_fields(tr.number_records(tr.parse_lines(tr.spawn_lines(tr.read_lines(spark, root)))))
    meta = sd.spawn_meta(sd.whole_files(spark, root, "agent-*.meta.json"))
    got = {r.agent_id: r for r in tr.spawns_of(recs, meta).collect()}
    a1 = got["a1"]
    assert (a1.agent_type, a1.requested_model, a1.model, a1.boot_tokens, a1.boot_cached, a1.requests, a1.output_tokens, a1.tool_uses) == ("lean", "opus", "claude-opus-5", 1110, 1000, 2, 11, 2)
    assert {k: v.last_stop_reason for k, v in got.items()} == {"a1": "handback", "a2": "tool_use", "a3": "end_turn", "a4": "stop_sequence"}
    assert got["a4"].workflow_run_id == "wf_9" and got["a4"].requests == 0 and got["a4"].model is None and got["a1"].open_requests == 0


def test_wells(spark, root):
    w = wl.discover(wl.file_index(spark, root)).first()
    assert (w.dir, w.sessions, w.has_memory, w.is_worktree, w.newest_session) == ("-u-code-app", 1, True, False, "s1")
    recs = tr.number_records(tr.parse_lines(tr.session_lines(tr.read_lines(spark, root))))
    assert [tuple(r) for r in wl.real_paths(recs).collect()] == [("-u-code-app", "/u/code/app")]


def test_usage_prices_and_poisons(spark):
    ts = lambda s: F.to_timestamp(F.lit(s))
    rows = [("s1", "m1", "claude-fable-5-1-x", "2026-08-31"), ("s1", "m2", "claude-fable-5-1", "2026-09-02"), ("s2", "m3", "mystery", "2026-09-02")]
    toks = {"input_tokens": 0, "cache_write_tokens": 1_000_000, "cache_write_1h_tokens": 2_000_000, "cache_read_tokens": 1_000_000, "output_tokens": 0, "thinking_tokens": 0}
    reqs = spark.createDataFrame(rows, "session_id string, message_id string, model string, d string").withColumns({"ts": F.to_timestamp("d"), **{k: F.lit(v).cast("bigint") for k, v in toks.items()}})
    sessions = spark.createDataFrame([("s1", "w1"), ("s2", "w1")], "session_id string, well string")
    c = Corpus(requests=reqs, sessions=sessions, wells=None, rates=pricing.rate_table(spark, RATES))
    got = {r.key: r for r in us.usage(c, "session").collect()}
    # the 1-hour slice is clipped to the write total; the longer prefix shadows the shorter one
    assert got["s1"].list_usd == pytest.approx(2 * (20 + 0.25)) and got["s2"].list_usd is None
    assert us.usage(c, "well").first().list_usd is None and [r.model for r in us.unpriced(c).collect()] == ["mystery"]
    assert us.totals(c, "day").first().list_usd is None and us.totals(c, "day").first().sessions == 2


def test_poll_shape_golden(spark):
    refs, secs = ["a", "a", "a", "a", None, "a", "a", "b"], [0, 5, 9, 14, 20, 25, 30, 40]
    data = [("s", i, 0, f"2026-01-01 00:00:{t:02d}", r) for i, (r, t) in enumerate(zip(refs, secs))]
    calls = spark.createDataFrame(data, "session_id string, line_no bigint, pos int, t string, ref string").withColumn("ts", F.to_timestamp("t"))
    r = waits.poll_shape(calls).first()
    assert (r.reads, r.files, r.rereads, r.runs, r.longest, r.in_runs, r.median_gap_s) == (7, 2, 5, 1, 4, 4, 5.0)
    alt = spark.createDataFrame([("s", i, 0, f"2026-01-01 00:00:{i:02d}", "ab"[i % 2]) for i in range(6)], "session_id string, line_no bigint, pos int, t string, ref string").withColumn("ts", F.to_timestamp("t"))
    r = waits.poll_shape(alt).first()
    assert (r.runs, r.longest, r.median_gap_s) == (0, 1, None)


def test_denials_end_to_end(spark, tmp_path):
    denied = user(3, [result("t1", "x")], toolDenialKind="automode-blocked", toolUseResult="Denied. Reason: touches prod If you have other tasks, go on")
    recs = [user(1, "go", promptId="P"), reply(2, "m1", call("t1", "Bash", command="cat /srv/prod/key.pem")), denied,
            reply(4, "m2", {"type": "text", "text": "Trying another way"}), reply(5, "m3", call("t2", "Bash", command="head -c 9 /srv/prod/key.pem"))]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "s1.jsonl").write_text("\n".join(json.dumps(r) for r in recs))
    (tmp_path / "w" / "s2.jsonl").write_text(json.dumps(user(1, "nothing here")))
    rows = dn.read_denials(tr.read_lines(spark, str(tmp_path)))
    r = rows.first()
    assert (r.kind, r.tool, r.cmd, r.reason, r.repo) == ("automode-blocked", "Bash", "cat /srv/prod/key.pem", "touches prod", "app")
    assert (r.next_cmd, r.next_text, r.human_first) == ("head -c 9 /srv/prod/key.pem", "Trying another way", False)
    assert [(s.shape, s.n, s.pct) for s in dn.shapes(rows).collect()] == [("different program, same target (READ THIS)", 1, 100)]


def test_strings_that_look_like_lists_stay_texts(spark):
    said = ['[{"a":1}]', '[{"a":1}] fix this json', "[]", '{"a":1}', "[ not json"]
    records = [user(i, t) for i, t in enumerate(said)] + [user(10 + i, [result(f"t{i}", t)]) for i, t in enumerate(said)]
    records += [user(20, [result("t9", [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}])]), user(21, []),
                {"type": "attachment", "timestamp": at(22), "sessionId": "s1", "attachment": {"type": "queued_command", "prompt": said[1]}},
                {"type": "attachment", "timestamp": at(23), "sessionId": "s1", "attachment": {"type": "queued_command", "prompt": [{"type": "text", "text": "listed"}]}}]
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "no long, value string")
    rows = {r.no: (r.lane, r.text) for r in tr.entries_of(tr.parse_lines(lines)).collect()}
    assert [rows[i] for i in range(5)] == [("prompt", t) for t in said]
    assert [rows[i] for i in range(5, 10)] == [("tool", t) for t in said]
    assert rows[10] == ("tool", "one\ntwo") and rows[11] == (None, None)
    assert rows[12] == ("prompt", said[1]) and rows[13] == ("prompt", "listed")


def test_reports_read_whole_texts(spark, tmp_path):
    long = "x" * 3000
    said = "a" * 1500 + " needlemiddle 3 failed, 4 passed " + "b" * 1500
    recs = [user(1, "go", promptId="P"), reply(2, "m1", call("t1", "Bash", command=f"pytest -q {long} one")), user(3, [result("t1", said)]),
            reply(4, "m2", call("t2", "Bash", command=f"pytest -q {long} two")), user(5, [result("t2", "4 passed")]),
            reply(6, "m3", call("t3", "SendMessage", summary="s", message=f"{long} endofmessage", to="ann")),
            {"type": "system", "subtype": "note", "timestamp": at(7), "sessionId": "s1", "content": f"{long} needlenote"}]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "s1.jsonl").write_text("\n".join(json.dumps(r, separators=(",", ":")) for r in recs))
    m = rf.index_sessions(spark, str(tmp_path)).messages
    rows = {r.line_no: r for r in m.collect()}
    assert rows[3].whole_text == said and len(rows[3].text) < len(said) and rows[2].whole_text.endswith(' one"}') and rows[7].whole_text.endswith("needlenote")
    assert len(rows[2].text) == len("Bash ") + 2000 and len(rows[7].text) == 2000 and rows[5].text == rows[5].whole_text == "4 passed"
    for word, line in (("needlemiddle", 3), ("one", 2), ("endofmessage", 6), ("needlenote", 7)):
        hits = sr.search(m, sr.all_words(word), 10).collect()
        assert [r.line_no for r in hits] == [line] and word in hits[0].snippet
    a = trc.annotations(trc.instructions(trc.bucketed(m))).first()
    assert (a.commands, a.retries, a.tests_ran, a.tests_failed, a.tests_passed) == (2, 0, 2, 1, 1)
    assert th.sent_halves(m).first().body.endswith("endofmessage")
    assert waits.calls_of(m).filter("line_no = 2").first().payload.endswith(' one"}')
    kept = rf.redacted(m, "/home/me")
    assert {"text", "whole_text"}.isdisjoint(kept.columns) and kept.filter("line_no = 3").first().whole_text_chars == len(said)


def test_rates_as_an_expression_equal_the_join(spark, monkeypatch):
    pairs = [(m, d) for m in ("claude-fable-5-1-x", "claude-fable-5", "claude-opus-4-8", "mystery", "", None) for d in ("2025-12-01", "2026-09-02", "2026-12-01", None)]
    rows = spark.createDataFrame(pairs, "model string, d string").select("model", F.to_date("d").alias("rate_day"), *[F.lit(1_000_000).cast("bigint").alias(t) for t in pricing.TOKENS])
    shown = lambda: sorted(map(str, pricing.priced(rows, pricing.rate_table(spark, RATES)).collect()))
    picked = shown()
    monkeypatch.setattr(pricing, "MAP_RATES", 0)
    assert picked == shown() and len(picked) == len(pairs)


def test_redaction_reaches_json_text(spark):
    said = {"detail": "the plan", "token": "t", "at": {"path": "/home/me/x"}, "tags": ["-home-me-y"], "more": 1}
    rows = spark.createDataFrame([(json.dumps(said),), ("no json",), (None,)], "state string")
    kind = "struct<detail:string,token:string,at:struct<path:string>,tags:array<string>>"
    got = [r.state for r in rf.redacted(rows, "/home/me", json={"state": kind}).collect()]
    assert json.loads(got[0]) == {"detail": "detail", "at": {"path": "/Users/u/x"}, "tags": ["-Users-u-y"]}
    assert got[1:] == ["{}", None]


def test_redaction_of_json_that_has_no_type(spark):
    said = {"zebra": {"apiSecret": "x", "deep": [[{"password": 1, "kept": None, "path": "/home/me/x"}]], "kind": "frame", "title": "plan", "id": "plan.html"}, "args": ["a" * 300, "/home/me"], "label": "", "href": 5,
            "detail": ["listed words"], "title": "t" * 100, "n": 12345678901234567890, "ok": True, "token": "t", "tokens": 3}
    rows = spark.createDataFrame([(json.dumps(said),), ("no json",), (None,), ("[" * 100_000,), ('"/home/me"',)], "state string")
    got = [r.state for r in rf.redacted(rows, "/home/me", json={"state": None}).collect()]
    assert json.loads(got[0]) == {"zebra": {"deep": [[{"kept": None, "path": "/Users/u/x"}]], "kind": "frame", "title": "frame", "id": "frame.html"}, "args": ["a" * 48 + "…", "/Users/u"], "label": "",
                                  "href": 5, "detail": ["detail"], "title": "t" * 80 + "…", "n": 12345678901234567890, "ok": True, "tokens": 3}
    assert list(json.loads(got[0])) == ["zebra", "args", "label", "href", "detail", "title", "n", "ok", "tokens"]
    assert got[1:] == ["{}", None, "{}", '"/Users/u"']


def test_denial_scan_opens_only_files_that_hold_one(spark, tmp_path, monkeypatch):
    (tmp_path / "w").mkdir()
    denied = [reply(1, "m1", call("t1", "Bash", command="ls /x")), user(2, [result("t1", "x")], toolDenialKind="user-rejected", toolUseResult="Reason: no")]
    for i in range(4):
        (tmp_path / "w" / f"s{i}.jsonl").write_text("\n".join(json.dumps(r) for r in (denied if i % 2 else [user(1, "calm")])))
    rows = [sorted((r.file_path.rsplit("/", 1)[1], r.cmd) for r in dn.scan_denials(spark, str(tmp_path)).collect())]
    monkeypatch.setattr(dn, "FILES_AT_ONCE", 1)
    rows.append(sorted((r.file_path.rsplit("/", 1)[1], r.cmd) for r in dn.scan_denials(spark, str(tmp_path)).collect()))
    assert rows == [[("s1.jsonl", "ls /x"), ("s3.jsonl", "ls /x")]] * 2
    (tmp_path / "calm").mkdir()
    (tmp_path / "calm" / "s9.jsonl").write_text(json.dumps(user(1, "calm")))
    assert dn.scan_denials(spark, str(tmp_path / "calm")).count() == 0


def test_parallel_calls_of_a_record_are_all_known(spark, tmp_path):
    denied = user(3, [result("t2", "x")], toolDenialKind="automode-blocked", toolUseResult="Reason: no")
    both = user(5, [result("t3", "x"), result("t4", "y")], toolDenialKind="user-rejected", toolUseResult="Reason: stop")
    recs = [reply(2, "m1", call("t1", "Read", file_path="/a")), denied, reply(4, "m2", call("t4", "Bash", command="rm -r /b")), both]
    recs[0]["message"]["content"].append(call("t2", "Bash", command="rm -r /b"))
    recs[2]["message"]["content"].append(call("t3", "Edit", file_path="/c"))
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "s1.jsonl").write_text("\n".join(json.dumps(r) for r in recs))
    first, second = dn.read_denials(tr.read_lines(spark, str(tmp_path))).orderBy("line_no").collect()
    assert (first.tool, first.cmd, first.next_cmd, first.next_denied) == ("Bash", "rm -r /b", "rm -r /b", "user-rejected")
    assert (second.tool, second.cmd, second.next_tool) == ("Edit", "/c", "")
    assert [s.shape for s in dn.shapes(dn.read_denials(tr.read_lines(spark, str(tmp_path)))).collect()] == ["RETRIED VERBATIM"]


def test_a_record_without_a_readable_time_stays(spark):
    from logloom.sources import side_files as sd

    said = ["2026-01-01T00:00:00Z", "not a time", "1767225600000", "", "9" * 25, "2026-13-45T99:00:00Z", None]
    records = [{**user(i, f"text {i}"), "timestamp": t} for i, t in enumerate(said)]
    refused = {"type": "assistant", "apiError": "usage_limit_reached", "apiErrorParams": {"rate_limit_info": {"rateLimitType": "five_hour", "resetsAt": 1e300}}, "message": {"model": "<synthetic>", "content": []}}
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate([*records, refused])], "no long, value string")
    rows = {r.no: r for r in tr.parse_lines(lines).collect()}
    assert [rows[i].ts and rows[i].ts.isoformat() for i in range(7)] == ["2026-01-01T00:00:00", None, "2026-01-01T00:00:00", None, None, None, None]
    assert rows[7].limit_kind == "five_hour"
    raw = spark.createDataFrame([(json.dumps({"ts": t, "session": "s", "kind": "k", "pct": 1.0, "resetsAt": z}), 0, i) for i, (t, z) in enumerate([("2026-01-01T00:00:00Z", "soon"), ("never", "2026-01-01T00:00:00Z")])],
                                "value string, block_start long, row_seq long")
    assert [(r.ts.isoformat(), r.resets_at) for r in sd.limit_log(raw).collect()] == [("2026-01-01T00:00:00", None)]
    run = json.dumps({"runId": "r", "script": "x()", "timestamp": "yesterday"})
    assert sd.workflow_runs(spark.createDataFrame([("/w/s/workflows/wf_r.json", run)], "file_path string, value string")).first().recorded_ts is None
