"""Feed lines and event JSON."""


from edit_signals.functions.codec import decode_events, encode_events, split_malformed
from edit_signals.operators import ingest_counts, key_by_title, main_namespace
from edit_signals.sources.sse import sse_payloads

SAMPLE = ('{"meta":{"dt":"2031-05-06"},"server":"mirror-7","parsed":null,"title":"Lighthouse keepers",'
          '"wiki":"nowiki","user":"Tidewatcher","bot":true,"timestamp":1936000123,"type":"new","comment":"stub, refs",'
          '"namespace":0,"length":{"old":0,"new":7321},"revision":{"old":0,"new":88001234}}')


def _event(title="Peat bog", ns=0, bot=False):
    return ('{"wiki":"fiwiki","title":"%s","namespace":%d,"bot":%s,"user":"Moss-77","type":"edit",'
            '"timestamp":1936000777,"length":{"old":61,"new":58},"revision":{"old":9000,"new":9007}}'
            % (title, ns, "true" if bot else "false"))


def _lines(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def _decode(spark, lines):
    good, bad = split_malformed(decode_events(sse_payloads(_lines(spark, lines))))
    return good, bad


def test_full_sample_with_unknown_fields(spark):
    good, bad = _decode(spark, ["data: " + SAMPLE])
    r = good.collect()[0]
    assert (r.title, r.wiki, r.user, r.bot, r.timestamp, r.type, r.comment, r.namespace) == \
        ("Lighthouse keepers", "nowiki", "Tidewatcher", True, 1936000123, "new", "stub, refs", 0)
    assert (r.revision.old, r.revision["new"], r.length.old, r.length["new"]) == (0, 88001234, 0, 7321)
    assert bad.count() == 0


def test_prefix_forms_and_ignored_lines(spark):
    lines = ["retry: 4000", "data: " + _event("A"), ":", "data:" + _event("B"), "event: heartbeat", "id: [7,\"x\"]", ""]
    good, bad = _decode(spark, lines)
    assert sorted(r.title for r in good.collect()) == ["A", "B"]
    assert bad.count() == 0


def test_malformed_is_quarantined_and_stream_goes_on(spark):
    cut, loose = _event("B")[:40], "title=Peat bog;bot=0"
    lines = ["data: " + _event("A"), "data: " + cut, "data: " + loose, "data: " + _event("C")]
    good, bad = _decode(spark, lines)
    assert sorted(r.title for r in good.collect()) == ["A", "C"]
    assert sorted(r.payload for r in bad.collect()) == sorted([cut, loose])


def test_other_rejected_payloads(spark):
    # single quotes, JSON null, empty payload, array, bare number, mistyped scalar
    payloads = ["{'title':'A'}", "null", "", "[1]", "5", '{"namespace":"0"}']
    good, bad = _decode(spark, ["data: " + p for p in payloads])
    assert good.count() == 0
    assert bad.count() == len(payloads)


def test_defaults_for_absent_fields(spark):
    good, _ = _decode(spark, ['data: {"title":"X","revision":{"new":7}}'])
    r = good.collect()[0]
    assert (r.bot, r.timestamp, r.namespace) == (False, 0, 0)
    assert (r.revision.old, r.revision["new"]) == (0, 7)
    assert r.length is None


def test_namespace_filter_and_key(spark):
    lines = ["data: " + _event("Peat bog", 0), "data: " + _event("Keskustelu:Peat bog", 1),
             "data: " + _event("Malline:Bog box", 10), 'data: {"title":"NoNs"}']
    good, _ = _decode(spark, lines)
    kept = key_by_title(main_namespace(good)).select("key", "title").collect()
    assert sorted(r.key for r in kept) == ["NoNs", "Peat bog"]
    assert all(r.key == r.title for r in kept)


def test_ingest_counts(spark):
    lines = ["data: " + _event("A", 0), "data: " + _event("B", 1), "data: [", ": c"]
    dec = decode_events(sse_payloads(_lines(spark, lines)))
    r = ingest_counts(dec).collect()[0]
    assert (r.published, r.filtered, r.failed) == (1, 1, 1)


def test_encode_writes_nulls_and_round_trips(spark):
    good, _ = _decode(spark, ['data: {"wiki":"enwiki","namespace":0}'])
    js = encode_events(good).select("value").first().value
    assert '"title":null' in js and '"bot":false' in js
    back = decode_events(encode_events(good).select("value"), payload="value", mode="strict")
    assert back.select("title", "wiki", "bot", "namespace").first() == (None, "enwiki", False, 0)


def test_strict_mode_fails_on_bad_json(spark):
    import pytest
    for bad in ('{"title":', "", "  "):
        df = spark.createDataFrame([(bad,)], "value string")
        with pytest.raises(Exception):
            decode_events(df, payload="value", mode="strict").collect()


def test_strict_mode_skips_records_without_a_value(spark):
    df = spark.createDataFrame([(None,), (_event("A", bot=True),)], "value string")
    assert [r.title for r in decode_events(df, payload="value", mode="strict").collect()] == ["A"]


def test_kafka_paths_are_gated(spark):
    import pytest
    from edit_signals import read_event_records, write_event_records
    from edit_signals.sources.records import kafka_available
    if kafka_available(spark):
        pytest.skip("Kafka connector present")
    with pytest.raises(RuntimeError):
        read_event_records(spark, "edits.raw", fmt="kafka")
    from edit_signals.streaming.detect import start_detection
    from edit_signals.streaming.ingest import start_ingest
    for start in (lambda: start_ingest(spark, "/tmp", "topic", "/tmp/q", "/tmp/c", sink_format="kafka"),
                  lambda: start_detection(spark, "/tmp", "topic", "/tmp/c", sink_format="kafka", output_mode="update")):
        with pytest.raises(RuntimeError, match="Kafka connector"):
            start()
    with pytest.raises(RuntimeError):
        write_event_records(spark.createDataFrame([("k", "v")], "key string, value string"), "t", fmt="kafka")


def test_event_time_from_record_or_payload(spark):
    import datetime as dt
    from edit_signals import with_event_time
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 5), 1704067260)], "record_ts timestamp, timestamp bigint")
    assert with_event_time(df).first().event_time == dt.datetime(2024, 1, 1, 0, 5)
    assert with_event_time(df, "payload").first().event_time == dt.datetime(2024, 1, 1, 0, 1)
