from tsudoi.operators import state


def test_saved_only_from_published_summaries(spark):
    events = spark.createDataFrame([(i, f"t{i}", "s") for i in range(1, 9)], "id long, title string, summary string")
    tr = spark.createDataFrame([(2, "en", "published", "x", "y"), (3, "en", "hidden", "x", "y"), (2, "fr", "draft", "x", "y")], "event_id long, locale string, status string, title string, summary string")
    summaries = spark.createDataFrame([(10 + i, i, "published", [" a ", "", None]) for i in (1, 2, 3, 5, 6)] + [(14, 4, "draft", ["a"]), (17, 7, "published", [" "]), (18, 8, "published", None)],
                                      "id long, event_id long, status string, bullets array<string>")
    stored = spark.createDataFrame([(15, "en", "published", ["old"]), (16, "en", "draft", ["old"]), (16, "fr", "hidden", ["old"])], "summary_id long, locale string, status string, bullets array<string>")
    d = lambda seq, event, forced=False, ask=True, bullets=("n", " ", "m"): (seq, event, "en", forced, ask, list(bullets))
    drafts = spark.createDataFrame([d(1, 1), d(2, 2), d(3, 3, True), d(4, 4), d(5, 5), d(6, 6, bullets=["first"]), d(7, 7), d(8, 8), d(9, 99), d(10, 1, ask=False), d(11, 6, bullets=[f"b{k}" for k in range(9)]), d(12, 5, True, None)],
                                   "seq long, event_id long, locale string, forced boolean, with_reaction boolean, bullets array<string>")
    got = {r.seq: r.outcome for r in state.reaction_translation_outcome(tr, drafts, events, summaries, stored).collect()}
    assert got == {1: "created_draft", 2: "event_translation_refused", 3: "created_draft", 4: "no_published_summary", 5: "refused_protected", 6: "saved_draft", 7: "no_bullets", 8: "no_bullets",
                   9: "event_translation_refused", 10: "not_asked", 11: "saved_draft", 12: "not_asked"}
    new = sorted((r.summary_id, r.locale, r.status, r.bullets) for r in state.save_reaction_translations(tr, drafts, events, summaries, stored).collect())
    assert new == [(11, "en", "draft", ["n", "m"]), (13, "en", "draft", ["n", "m"]), (15, "en", "published", ["old"]), (16, "en", "draft", [f"b{k}" for k in range(5)]), (16, "fr", "hidden", ["old"])]
