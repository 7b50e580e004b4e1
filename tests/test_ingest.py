"""Files arriving in a folder become tables; a file arriving again replaces its document."""

from scholion.streaming import ingest

TEMPLATE = """<?xml version="1.0"?><article><front><article-meta><article-id pub-id-type="doi">10.1/{n}</article-id>
<title-group><article-title>{title}</article-title></title-group></article-meta></front>
<body><sec><title>Methods</title><p>{text}</p></sec></body></article>"""


def test_files_are_ingested_once_and_replaced_by_newer_versions(spark, tmp_path):
    inbox, base, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    (inbox / "a.xml").write_text(TEMPLATE.format(n=1, title="First", text="one two three"))
    (inbox / "b.json").write_text('{"error": "limit"}')

    def run():
        # Documents are keyed by file name, so a later copy in a subfolder is a new version.
        from pyspark.sql import functions as F
        from scholion.operators.articles import parse_articles

        def parser(raw):
            name = F.element_at(F.split("object_key", "/"), -1)
            return parse_articles(raw.withColumn("name", name), "name")

        ingest.ingest_stream(spark, str(inbox), base, state, parser=parser).awaitTermination()

    run()
    run()
    docs = ingest.current_documents(spark, base).collect()
    assert [(d.title, d.processing_attempts, d.quality_score) for d in docs] == [("First", 1, 0.34)]
    bad = ingest.read_versions(spark, base, "quarantine").collect()
    assert len(bad) == 1 and bad[0].reason == "no parser takes this object"
    assert bad[0].details["content_preview"].startswith('{"error"')

    (inbox / "again").mkdir()
    (inbox / "again" / "a.xml").write_text(TEMPLATE.format(n=1, title="Second", text="four five"))
    run()
    docs = ingest.current_documents(spark, base).collect()
    assert [(d.title, d.processing_attempts) for d in docs] == [("Second", 2)]
    chunks = ingest.current_chunks(spark, base).collect()
    assert [(c.content, c.section_type) for c in chunks] == [("four five", "methods")]
    assert len(chunks[0].embedding) == 256 and chunks[0].embedding_model_id == "hashed-words"
