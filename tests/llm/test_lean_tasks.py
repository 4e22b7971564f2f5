"""What a task leaves in its worker."""

import weakref

import public_tokenizers
import pyarrow as pa

from tidelog.llm import byte_bpe, common, jaccard, quality


def test_memory_is_given_back_when_a_task_holds_nothing_any_more(monkeypatch):
    class Held:
        pass

    held, at_trim = [], []
    monkeypatch.setattr(common, "_trim", lambda: lambda pad: at_trim.append([h() for h in held]))

    def run(batches):
        for batch in batches:
            mine = Held()
            held.append(weakref.ref(mine))
            yield batch

    batches = [pa.RecordBatch.from_pydict({"a": [i]}) for i in range(3)]
    task = common.lean(run)(iter(batches))
    assert [next(task), next(task), next(task)] == batches and not at_trim
    assert list(task) == [] and at_trim == [[None, None, None]]


def test_stages_of_the_pipeline_are_lean(spark, monkeypatch):
    made = []
    for module in (byte_bpe, jaccard, quality):
        monkeypatch.setattr(module, "lean", lambda run, name=module.__name__: made.append(name) or run)
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    byte_bpe.round_trip(docs), quality.keep_documents(docs), jaccard.shingle_sets(docs)
    assert {"tidelog.llm.byte_bpe", "tidelog.llm.quality", "tidelog.llm.jaccard"} == set(made)


def test_tasks_of_the_byte_coder_get_texts_in_small_batches(spark, monkeypatch):
    def sizes(run):
        def seen(batches):
            for batch in batches:
                none = pa.array([b""], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), none, none], ["id", "ids", "decoded"])

        return seen

    monkeypatch.setattr(byte_bpe, "lean", sizes)
    session = spark.newSession()
    docs = session.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text")
    given = [r.id for r in byte_bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()]
    assert sum(given) > 2000 * 10_000 and max(given) <= 2 * common.SLICE_BYTES


def test_a_limit_of_the_session_itself_stays(spark):
    session = spark.newSession()
    docs = session.createDataFrame([(1, "one two three")], "doc_id long, text string")
    assert session.conf.get(common.BATCH_LIMIT, None) is None
    quality.keep_documents(docs)
    assert session.conf.get(common.BATCH_LIMIT) == str(common.SLICE_BYTES)
    session.conf.set(common.BATCH_LIMIT, "12345")
    byte_bpe.round_trip(docs), jaccard.shingle_sets(docs)
    assert session.conf.get(common.BATCH_LIMIT) == "12345"
