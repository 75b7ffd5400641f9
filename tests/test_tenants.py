"""Two tenants whose ids coincide: every operator must give what it gives for each alone."""

import json

import pytest
from pyspark.sql import functions as F

from examlake.operators import bank, classify, expected, extraction, knowledge, merging, papers, records, scans, vectors, workflow

STEM = {"a": "Explain why the electric field inside a hollow conductor vanishes", "b": "State the second law of motion and derive its vector form"}
MORE = {"a": "(ii) and what happens on the outer surface of it?", "b": "(ii) and write it for a body of changing mass?"}


def _rows(spark, schema, of):
    """A table of both tenants' rows; of(owner) gives one tenant's."""
    return spark.createDataFrame([(o, *r) for o in "ab" for r in of(o)], "owner_id string, " + schema)


@pytest.fixture(scope="module")
def tables(spark):
    t = {}
    t["items"] = _rows(spark, "paper_id string, page_no int, page_width double, str string, x double, y double", lambda o: [
        ("p1", 1, 600.0, f"1. {STEM[o]} today?", 40.0, 700.0), ("p1", 1, 600.0, "3" if o == "a" else "5", 560.0, 700.0), ("p1", 1, 600.0, f"2. {STEM['b' if o == 'a' else 'a']} again", 40.0, 650.0 if o == "a" else 698.0)])
    t["documents"] = _rows(spark, "paper_id string, text string", lambda o: [("p1", f"1. {STEM[o]} [2 marks]\n2. {MORE[o][5:]} [3 marks]")])
    t["pages"] = _rows(spark, "paper_id string, page_no int, text string", lambda o: [("p1", 1, STEM[o] * (300 if o == "a" else 1)), ("p1", 2, MORE[o] * 300)])
    t["answers"] = _rows(spark, "paper_id string, answer_no int, answer string", lambda o: [("p1", 0, json.dumps({"questions": [{"questionNo": "1", "questionText": STEM[o]}, {"questionNo": "2", "questionText": STEM[o] + " there"}]}))][: 1 if o == "a" else 2])
    t["questions"] = _rows(spark, "paper_id string, row_order long, question_no int, question_text string, marks double, has_figure boolean", lambda o: [
        ("p1", 0, 1, STEM[o], None, False), ("p1", 1, 9, MORE[o], 2.0 if o == "a" else None, o == "b"), ("p1", 2, 1, STEM[o] + " today", None, False), ("p1", 3, 2, STEM["ab"[o == "a"]] + "\n22. Derive the lens formula for a thin lens", None, False)][: 4 if o == "a" else 3])
    t["papers"] = _rows(spark, "paper_id string, class_id string, expected_count int, instructions string", lambda o: [("p1", "c1", 2 if o == "a" else 3, "Section A - Questions 1 to 5 carries 4 mark." if o == "a" else None)])
    t["continuations"] = _rows(spark, "paper_id string, question_no int, pos long, append_text string", lambda o: [("p1", 1, 0, MORE[o]), ("p1", 7, 1, STEM[o])][: 1 if o == "b" else 2])
    t["single"] = _rows(spark, "paper_id string, row_order long, question_no int, question_text string", lambda o: [("p1", 0, 1, STEM[o])])
    t["concepts"] = _rows(spark, "chapter_id string, pos int, name string", lambda o: [("k1", 0, "Gauss' Law" if o == "a" else "gauss law"), ("k1", 1, "Flux" if o == "a" else "GAUSS LAW")])
    t["materials"] = _rows(spark, "chapter_id string, chapter_name string, material_id string, created_at long, text string, summary string, matches_chapter boolean, error string", lambda o: [("k1", "v" + o, "m1", 1 if o == "a" else 2, "text", "s" + o, o == "a", None)])
    t["knowledge"] = _rows(spark, "chapter_id string, class_id string, title_embedding array<double>, summary_embedding array<double>", lambda o: [("k1", "c1", [1.0, 0.0], None if o == "a" else [0.0, 1.0]), ("k2", "c1" if o == "a" else "c2", [0.5, 0.5], [1.0, 1.0])])
    t["chapter_concepts"] = _rows(spark, "chapter_id string, position int, concept_embedding array<double>", lambda o: [("k1", 0, [1.0, 1.0 if o == "a" else 2.0])])
    t["chapters"] = _rows(spark, "class_id string, chapter_pos long, chapter_id string, unit_id string, name string", lambda o: [("c1", 0, "k1", "u" + o, f"Chapter 1: {'Electric field conductor' if o == 'a' else 'Second law motion'}"), ("c1", 1, "k2", "u2", "Chapter 2: Optics " + o)])
    t["asked"] = _rows(spark, "paper_id string, row_order long, question_no int, question_text string, class_id string, question_id string, embedding array<double>, unit_id string, chapter_id string, chapter_name string, chapter_confidence int", lambda o: [("p1", 0, 1, STEM[o], "c1", "q1", [1.0, 0.1 if o == "a" else 0.9], None, None, None, None), ("p1", 1, 2, MORE[o], "c1", "q2", [0.2, 1.0], None, None, None, None)][: 2 if o == "a" else 1])
    t["assignments"] = _rows(spark, "paper_id string, question_no int, pos long, chapter_id string, chapter_name string, confidence double", lambda o: [("p1", 1, 0, "k1" if o == "a" else "k2", None, 80.0)])
    t["overrides"] = _rows(spark, "paper_id string, question_no int, chapter_id string, confidence double", lambda o: [("p1", 1, "k2", 0.9)][: 1 if o == "a" else 0])
    t["bank"] = _rows(spark, "paper_id string, question_no int, question_text string, marks double, chapter_id string, unit_id string, chapter_name string, chapter_confidence int", lambda o: [("p1", 5, "old " + o, 1.0, None, None, None, None), ("p2", 1, "kept " + o, 1.0, None, None, None, None)])
    return t


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


VECTORS = [("va", [1.0, 0.0]), ("vb", [0.0, 1.0]), ("sa", [1.0, 1.0]), ("Flux", [0.3, 0.1])]


def _vectors(t):
    return t["items"].sparkSession.createDataFrame(VECTORS, "input string, embedding array<double>")


OPERATORS = {
    "lines_of_items": lambda t: extraction.lines_of_items(t["items"]),
    "layout_questions": lambda t: extraction.layout_questions(t["items"]),
    "text_questions": lambda t: extraction.text_questions(t["documents"]),
    "text_chunks": lambda t: extraction.text_chunks(t["pages"]),
    "flatten_model_answers": lambda t: extraction.flatten_model_answers(t["answers"]),
    "choose_extraction": lambda t: extraction.choose_extraction(("layout", extraction.layout_questions(t["items"]).where("owner_id = 'a'")), ("text", extraction.text_questions(t["documents"]))),
    "validated_questions": lambda t: papers.validated_questions(t["questions"], t["papers"]),
    "validation_report": lambda t: papers.validation_report(t["questions"], t["papers"]),
    "apply_continuations": lambda t: papers.apply_continuations(t["single"], t["continuations"]),
    "document_text": lambda t: papers.document_text(t["pages"]),
    "merge_questions": lambda t: merging.merge_questions(t["questions"]),
    "split_long_rows": lambda t: merging.split_long_rows(t["questions"]),
    "finalize_questions": lambda t: merging.finalize_questions(t["questions"], t["papers"]),
    "best_per_number": lambda t: merging.best_per_number(t["questions"]),
    "drop_near_copies": lambda t: merging.drop_near_copies(t["questions"]),
    "continue_questions": lambda t: merging.continue_questions(t["single"], t["continuations"]),
    "concept_names": lambda t: knowledge.concept_names(t["concepts"]),
    "knowledge": lambda t: knowledge.build_knowledge(t["materials"], t["concepts"], _vectors(t))[0],
    "built_concepts": lambda t: knowledge.build_knowledge(t["materials"], t["concepts"], _vectors(t))[1],
    "chapter_profiles": lambda t: knowledge.chapter_profiles(t["knowledge"], t["chapter_concepts"]),
    "classify_vector": lambda t: vectors.classify_vector(t["asked"].select("owner_id", "class_id", "question_id", "embedding"), knowledge.chapter_profiles(t["knowledge"], t["chapter_concepts"])),
    "classify_keyword": lambda t: classify.classify_keyword(t["asked"], t["chapters"]),
    "apply_assignments": lambda t: classify.apply_assignments(t["asked"], t["assignments"], t["chapters"]),
    "apply_overrides": lambda t: classify.apply_overrides(t["asked"], t["overrides"], t["chapters"]),
    "classify": lambda t: workflow.classify(t["asked"], t["chapters"], knowledge.chapter_profiles(t["knowledge"], t["chapter_concepts"]), t["assignments"]),
    "processed_bank": lambda t: workflow.process_papers(t["bank"], t["questions"], t["papers"], t["chapters"], t["overrides"])[0],
    "processed_reports": lambda t: workflow.process_papers(t["bank"], t["questions"], t["papers"], t["chapters"], t["overrides"])[1],
    "repair_set": lambda t: bank.repair_set(t["questions"], t["papers"]),
    "near_duplicate_pairs": lambda t: bank.near_duplicate_pairs(t["questions"]),
    "replace_numbers": lambda t: scans.replace_numbers(t["questions"], t["questions"].where("owner_id = 'a' and row_order = 2")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_tenants_stay_apart(tables, name):
    run = OPERATORS[name]
    got = run(tables)
    assert "owner_id" in got.columns
    show = lambda df: sorted(map(str, df.collect()))
    alone = [show(run({k: t.where(F.col("owner_id") == o) for k, t in tables.items()})) for o in "ab"]
    assert alone[0] and show(got) == sorted([*alone[0], *alone[1]])
