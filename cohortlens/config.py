"""Domain constants.

FIXED VALUES: the values below must equal the analysed notebooks' values for the
results to match (stage ranges, metric names, maps, thresholds, rule texts).
They are stated plainly, in natural order.
"""

from __future__ import annotations

# --- FIXED VALUES: stages (grade ranges, inclusive) -------------------------------
STAGES: dict[str, tuple[int, int]] = {
    "Lower_Primary": (1, 4),
    "Upper_Primary": (5, 8),
    "Secondary": (9, 10),
    "Preparatory": (11, 12),
}

# grade dimension: cycle by fours, stage elementary 1-8 / high school 9-12
GRADE_CYCLES: dict[str, tuple[int, int]] = {
    "Primary": (1, 4),
    "Middle": (5, 8),
    "Secondary": (9, 12),
}
GRADE_STAGES: dict[str, tuple[int, int]] = {
    "Elementary": (1, 8),
    "High School": (9, 12),
}

# --- FIXED VALUES: metrics (column suffix -> short name used in stage columns) ------
METRICS: dict[str, str] = {
    "Test_Score": "Test_Score",
    "Attendance": "Attendance",
    "Homework_Completion": "HW_Completion",
    "Class_Participation": "Participation",
}
TEXTBOOK_METRIC = "Textbook"
ALL_METRICS = list(METRICS) + [TEXTBOOK_METRIC]

# --- FIXED VALUES: exam tracks -----------------------------------------------------
TRACKS: dict[str, list[str]] = {
    "Social": ["History", "Geography", "Economics", "Math_Social"],
    "Natural": ["Biology", "Chemistry", "Physics", "Math_Natural"],
    "Common": ["Aptitude", "English", "Civics_and_Ethical_Education"],
}

# --- FIXED VALUES: categorical maps --------------------------------------------------
BINARY_MAPS: dict[str, dict[str, int]] = {
    "Gender": {"Male": 0, "Female": 1},
    "Home_Internet_Access": {"No": 0, "Yes": 1},
    "Electricity_Access": {"No": 0, "Yes": 1},
    "School_Location": {"Rural": 0, "Urban": 1},
}
FIELD_CHOICE_MAP = {"Social": 0, "Natural": 1}
EDUCATION_MAP = {"Unknown": 0, "Primary": 1, "High School": 2, "College": 3, "University": 4}
HEALTH_SEVERITY = {
    "No Issue": 0,
    "Dental Problems": 1,
    "Vision Issues": 1,
    "Hearing Issues": 1,
    "Anemia": 2,
    "Parasitic Infections": 2,
    "Respiratory Issues": 2,
    "Malnutrition": 2,
    "Physical Disability": 3,
    "Chronic Illness": 3,
}
HEALTH_DEFAULT_SEVERITY = 1
YES_TOKENS = ["yes", "y", "true", "1", "available"]

# subject -> category by substring, first match wins, in this order
SUBJECT_CATEGORIES: list[tuple[str, list[str]]] = [
    ("STEM", ["Math", "Physics", "Chemistry", "Biology", "ICT"]),
    ("Humanities", ["History", "Geography", "Economics", "Civics"]),
    ("Language", ["English", "Amharic", "Affan_Oromoo", "Oromo"]),
]
# three-way variant of the second ETL (anything else is Language/Other)
SUBJECT_CATEGORIES_3WAY: list[tuple[str, list[str]]] = [
    ("STEM", ["Math", "Physics", "Chemistry", "Biology", "ICT", "Technical"]),
    ("Humanities", ["History", "Geography", "Economics", "Civics", "Social", "Business"]),
]
SUBJECT_CATEGORY_3WAY_DEFAULT = "Language/Other"
SUBJECT_CATEGORY_DEFAULT = "Other"

# --- FIXED VALUES: thresholds ---------------------------------------------------------
TIER_BINS = [(0, 50, "Critical"), (50, 70, "Needs Improvement"), (70, 85, "Satisfactory"), (85, 100, "Excellent")]
LEVEL_BANDS = [(50, "Low"), (70, "Medium")]  # < 50 Low, < 70 Medium, else High
PASS_MARK = 50.0
EXAM_PASS_MARK = 350.0
RISK_MARK = 50.0
PARENTAL_CUTS = (0.33, 0.66)
REFERENCE_DATE = "2026-01-30"
SERVING_DEFAULT_AGE = 17
KFOLD_SPLITS = 5
SMOOTHING_ALPHA = 10.0
ONE_HOT_MAX_UNIQUE = 8
ENGAGEMENT_WEIGHTS = (0.4, 0.3, 0.3)  # attendance, homework, participation
BLEND_WEIGHTS = (0.5, 0.3, 0.2)

# serving defaults when a column is absent
DEFAULT_FILLS: dict[str, object] = {
    "Overall_Avg_Attendance": 75.0,
    "Overall_Avg_Homework": 65.0,
    "Overall_Avg_Participation": 70.0,
    "Teacher_Student_Ratio": 40.0,
    "School_Resources_Score": 0.5,
    "Overall_Textbook_Access_Composite": 0.5,
    "Parental_Involvement": 0.5,
    "School_Academic_Score": 0.5,
}

# --- FIXED VALUES: fallback score (weights, scale, offset) ----------------------------
FALLBACK_WEIGHTS = {
    "resources": 60.4,
    "engagement": 17.9,
    "textbook": 7.14,
    "attendance": 2.87,
    "ratio": 2.02,
    "homework": 1.72,
    "participation": 0.85,
}
FALLBACK_SCALE = 0.8
FALLBACK_OFFSET = 20.0
LOGISTIC_SLOPE = 0.15
LOGISTIC_CENTER = 50.0
