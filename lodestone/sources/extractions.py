"""The nine extractions from the source database: view, columns, equality filters, order."""

from __future__ import annotations

# Views and their columns; no columns means all.
EXTRACTIONS: dict[str, tuple[str, tuple[str, ...], dict[str, str], tuple[str, ...]]] = {
    "diploma": ("RAS_USER.V_ADD_ACADEMIC_INFO", ("STUDENT_ID", "DIPLOMA_GPA", "DIPLOMA_TYPE_ID", "DIPLOMA_STATE_ID", "DIPLOMA_COUNTRY_SL", "DIPLOMA_TYPE_SL"), {"ACTIVE": "A"}, ()),
    "enrolment": (
        "RAS_USER.V_CRG_STUDENT_COURSE",
        ("STUDENT_COURSE_ID", "STUDENT_ID", "COURSE_ID", "PART_ID", "GRADE_ID", "FINAL_MARK", "POINTS", "FINISH_STATUS", "COURSE_NAME_SL", "REGISTER_STATUS", "IN_CREDITS", "IN_GPA", "IN_AGPA", "STUDY_MODE", "DEGREE_ID", "STUDENT_NAME_SL", "DEGREE_NAME_SL", "FACULTY_ID", "COURSE_CREDITS", "ACTIVE"),
        {"ACTIVE": "A", "STUDY_MODE": "C"},
        (),
    ),
    "grades": ("RAS_USER.V_ACS_GRADE", ("GRADE_ID", "GRADE_VERSION_ID", "GRADE_NAME_SL", "VERSION_TITLE_SL", "VERSION_NUMBER", "FROM_PERCENT", "TO_PERCENT", "POINTS", "FINISH_STATUS", "GRADE_SHOW", "ACTIVE"), {"ACTIVE": "A"}, ()),
    "status": (
        "RAS_USER.V_ADD_STUDENT_DEGREE_STATUS",
        (
            "STUDENT_STATUS_ID", "STUDENT_ID", "PART_ID", "DEGREE_ID", "START_PART_ID", "FINISH_PART_ID", "GRADE_VERSION_ID", "PERMANENT_STATUS_ID", "PERMANENT_STATUS_SL", "STUDY_MODE",
            "PREV_GPA_POINTS", "PREV_GPA_PERCENT", "GPA_PERCENT", "GPA_POINTS", "START_AGPA_PERCENT", "START_AGPA_POINTS", "START_TOTAL_IN_COURSES", "START_TOTAL_IN_CREDITS", "END_TOTAL_IN_COURSES", "END_TOTAL_IN_CREDITS",
            "END_AGPA_PERCENT", "END_AGPA_POINTS", "SEMESTER_REG_COURSES", "SEMESTER_REG_CREDITS", "SEMESTER_PASS_COURSES", "SEMESTER_PASS_CREDITS", "SEMESTER_FAIL_COURSES", "SEMESTER_FAIL_CREDITS", "SEMESTER_IN_COURSES", "SEMESTER_IN_CREDITS",
            "TOTAL_SEMESTERS", "TOTAL_REG_COURSES", "TOTAL_REG_CREDITS", "TOTAL_PASS_COURSES", "TOTAL_PASS_CREDITS", "TOTAL_FAIL_COURSES", "TOTAL_FAIL_CREDITS", "REG_TOTAL_SEMESTERS", "FINISH_STATUS", "VERSION_TITLE_SL",
            "DEGREE_NAME_SL", "DEGREE_CREDITS_COUNT", "START_LEVEL_ID", "START_LEVEL_NAME_SHORT", "END_LEVEL_NAME_SHORT", "START_LEVEL_NAME_PL",
        ),
        {"STUDY_MODE": "C", "ACTIVE": "A"},
        (),
    ),
    "catalogue": (
        "RAS_USER.V_ACD_DEGREE_COURSE",
        ("DEGREE_COURSE_ID", "COURSE_ID", "DEGREE_ID", "COURSE_TYPE_ID", "REQUIREMENT_TYPE_ID", "REQUIREMENT_TYPE_SL", "COURSE_NAME_SL", "COURSE_OFFICIAL_SL", "DEGREE_NAME_SL", "YEAR_ORDER", "SEMESTER_ORDER", "COURSE_CREDITS", "ACTIVE", "CREDITS_COUNT"),
        {"ACTIVE": "A"},
        (),
    ),
    "passed_credit": ("RAS_USER.V_CRG_STUDENT_PASSED_CREDIT", ("STUDENT_ID", "REQUIREMENT_TYPE_PL", "REQUIREMENT_TYPE_SL", "CREDITS_COUNT", "PASSED_CREDIT"), {}, ()),
    "offers": (
        "RAS_USER.V_SCH_COURSE_OFFER",
        ("LEVEL_CATEGORY_ID", "PART_ID", "DEPARTMENT_ID", "FACULTY_ID", "COURSE_ID", "COURSE_TYPE_ID", "COURSE_NAME_SL", "FACULTY_NAME_SL", "DEPARTMENT_NAME_SL", "COURSE_CREDITS", "COURSE_STATUS", "ALLOW_REGISTER"),
        {"ACTIVE": "A"},
        (),
    ),
    "requests": (
        "RAS_USER.V_CRG_STD_COR_TEMP_REQUEST",
        ("STD_COR_TEMP_REQUEST_ID", "STUDENT_ID", "PART_ID", "COURSE_ID", "COURSE_TYPE_ID", "REQUIREMENT_TYPE_ID", "ALLOW_REGISTER", "IS_REQUESTABLE", "GPA_PERCENT", "GPA_POINTS", "END_AGPA_POINTS", "CREDITS_TILL_GRAD", "REQUIREMENT_PASSED_CREDITS", "CREDITS_COUNT", "COURSE_CREDITS", "YEAR_ORDER", "SEMESTER_ORDER", "REGISTER_STATUS", "FINISH_STATUS"),
        {},
        ("STUDENT_ID", "PART_ID", "COURSE_ID", "REQUIREMENT_TYPE_ID"),
    ),
    "prerequisites": ("RAS_USER.V_COR_COURSE_PREREQUISITE", (), {}, ()),
}
