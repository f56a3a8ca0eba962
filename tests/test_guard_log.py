from tsudoi.operators import guard

SOURCES = "event_id long, excerpt string, class string"
MODEL = ("event_id long, bullets array<struct<text:string,theme:string,evidence_count:int,cited:array<string>>>, signals map<string,string>, recommended_time string, recommended_evidence int, confidence string")


def log(spark, model, sources):
    out = guard.guard_actions(spark.createDataFrame(model, MODEL), spark.createDataFrame(sources, SOURCES)).collect()
    return {e: {(r.step, r.action): r.n for r in out if r.event_id == e} for e in {r.event_id for r in out}}


def test_each_step_is_logged(spark):
    src = [(1, x, "experience") for x in ("楽しかった！写真も撮った", "面白かった。混雑していた", "混んでいたが楽しめた")] + [(1, "公式情報", "official")]
    bullet = lambda text, theme, n: (text, theme, n, [])
    model = [(1, [bullet("全体的に好意的です", "enjoyment", 9), bullet("混雑していたという声があります", "crowd", 9), bullet("最寄り駅の電車が遅延", "other", 1), bullet("屋内で楽しめた", "enjoyment", 2)],
              {"crowd": "positive", "rain": "positive"}, "平日", 9, "high")]
    got = log(spark, model, src)[1]
    # what it kept, dropped and changed, against the guard's own result on the same rows (tests/test_state_pages.py)
    assert {a for s, a in got if s == 3} == {"drop_wrap_up", "drop_peripheral", "drop_room_not_in_sources"}
    assert (2, "evidence_capped_crowd") in got and (7, "inject_enjoyment_bullet") in got and (7, "inject_photo_bullet_single") in got
    assert (11, "signal_rain_cleared_low_experience_0") in got and (12, "recommended_time_cleared") in got and (13, "confidence_capped_high_to_low") in got
    assert not any(s in (8, 9, 10) for s, _ in got)


def test_duplicates_fallback_and_quiet_events(spark):
    bullet = lambda text, theme, n: (text, theme, n, [])
    src = [(1, "混雑していた", "experience")] * 2 + [(2, "公式情報", "official")]
    model = [(1, [bullet("混雑に触れた投稿", "crowd", 2), bullet("混雑に触れた投稿です", "crowd", 1), bullet("混んでいた", "crowd", 5)], {"crowd": "mixed"}, None, None, "low"),
             (2, [bullet("写真が撮れる", "photo", 3)], {"crowd": "unknown"}, " ", 5, "low"), (3, [], {}, None, None, "odd")]
    got = log(spark, model, src)
    assert got[1][(8, "drop_duplicate_theme_crowd")] == 2 and got[1][(2, "evidence_capped_crowd")] == 1 and got[1][(2, "evidence_raised_crowd")] == 1
    assert {(2, "no_experience_evidence_photo"), (3, "drop_no_first_hand"), (10, "fallback_low_source_note")} <= set(got[2]) and not any(s in (11, 12, 13) for s, _ in got[2])
    assert set(got[3]) == {(10, "fallback_low_source_note")}


def test_near_copies_are_logged(spark):
    src = [(1, x, "experience") for x in ("楽しかった", "面白かった", "混雑していた", "混んでいた")]
    bullet = lambda text, theme, n: (text, theme, n, [])
    model = [(1, [bullet("楽しかったという投稿が会場であります", "enjoyment", 2), bullet("混んでいて楽しかったという投稿が会場であります", "crowd", 2)], {}, None, None, "low")]
    got = log(spark, model, src)[1]
    kept = guard.guard_summaries(spark.createDataFrame(model, MODEL), spark.createDataFrame(src, SOURCES)).head()
    assert len(kept.bullets) == 2 - got.get((9, "dedupe_bullets"), 0)
