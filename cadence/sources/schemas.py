"""Schemas of the delivery tables (silver layer) and of landed source documents."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_L = T.LongType()
_I = T.IntegerType()
_TS = T.TimestampType()
_B = T.BooleanType()
POINTS = T.DecimalType(6, 1)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


PROJECTS = _struct(
    ("id", _L), ("jira_key", _S), ("name", _S), ("description", _S),
    ("lead_email", _S), ("jira_project_id", _S), ("board_id", _L),
    ("synced_at", _TS), ("updated_at", _TS),
)

SPRINTS = _struct(
    ("id", _L), ("jira_sprint_id", _L), ("project_id", _L), ("name", _S),
    ("state", _S), ("goal", _S), ("start_date", _TS), ("end_date", _TS),
    ("complete_date", _TS), ("synced_at", _TS), ("updated_at", _TS),
)

ISSUES = _struct(
    ("id", _L), ("jira_issue_id", _S), ("project_id", _L), ("sprint_id", _L),
    ("issue_type", _S), ("priority", _S), ("status", _S), ("status_category", _S),
    ("summary", _S), ("description", _S), ("acceptance_criteria", _S),
    ("has_ac", _B), ("story_points", POINTS), ("original_estimate", _L),
    ("time_spent", _L), ("remaining_estimate", _L), ("assignee_email", _S),
    ("reporter_email", _S), ("created_at_jira", _TS), ("updated_at_jira", _TS),
    ("in_progress_at", _TS), ("done_at", _TS), ("due_date", T.DateType()),
    ("added_mid_sprint", _B), ("synced_at", _TS), ("updated_at", _TS),
)

STATUS_HISTORY = _struct(
    ("issue_id", _L), ("from_status", _S), ("to_status", _S),
    ("transitioned_at", _TS), ("author_email", _S),
)

SYNC_LOG = _struct(
    ("id", _L), ("project_id", _L), ("sync_type", _S), ("status", _S),
    ("issues_synced", _L), ("sprints_synced", _L), ("error_message", _S),
    ("started_at", _TS), ("finished_at", _TS),
)

# ── landed source documents (as pulled from the tracker's REST API) ──────────

_NAME = _struct(("name", _S))
_EMAIL = _struct(("emailAddress", _S))

CHANGE_ITEM = _struct(("field", _S), ("fromString", _S), ("toString", _S))
HISTORY_ENTRY = _struct(("created", _S), ("author", _EMAIL), ("items", T.ArrayType(CHANGE_ITEM)))
CHANGELOG = _struct(("startAt", _L), ("histories", T.ArrayType(HISTORY_ENTRY)))


def issue_fields(story_points_field: str = "story_points", ac_field: str = "acceptance_criteria") -> T.StructType:
    """Issue ``fields`` struct; the two configurable field names are arguments."""
    fields = [
        ("summary", _S), ("description", _S), ("issuetype", _NAME), ("priority", _NAME),
        ("status", _struct(("name", _S), ("statusCategory", _NAME))),
        ("assignee", _EMAIL), ("reporter", _EMAIL),
        ("created", _S), ("updated", _S), ("duedate", _S),
        ("timeoriginalestimate", _L), ("timespent", _L), ("timeestimate", _L),
        ("story_points", _S),
    ]
    names = {n for n, _ in fields}
    for extra in (story_points_field, ac_field):
        if extra not in names:
            fields.append((extra, _S))
            names.add(extra)
    return _struct(*fields)


def issue_doc(story_points_field: str = "story_points", ac_field: str = "acceptance_criteria") -> T.StructType:
    """One landed issue document. ``seq`` is the landing order (file, page, position)."""
    return _struct(
        ("id", _S),
        ("key", _S),
        ("fields", issue_fields(story_points_field, ac_field)),
        ("changelog", CHANGELOG),
    )


BOARD_DOC = _struct(("id", _L), ("name", _S), ("type", _S))


SPRINT_DOC = _struct(
    ("id", _L), ("name", _S), ("state", _S), ("goal", _S),
    ("startDate", _S), ("endDate", _S), ("completeDate", _S),
)

PROJECT_DOC = _struct(
    ("id", _S), ("key", _S), ("name", _S), ("description", _S), ("lead", _EMAIL),
)
