"""Closed vocabularies of the data model.

Fixed values: codes, phrases and their order are part of the published data model, so they are
stated as they are.
"""

TAXONOMY_VERSION = "1.0.0"
THIN_SAMPLE = 10
DATA_START = "2025-01-01"

# (code, public), in presentation order
OUTCOME_CATEGORIES = [
    ("dismissed", True),
    ("withdrawn", True),
    ("guilty_plea", True),
    ("guilty_verdict", True),
    ("acquittal", True),
    ("ard", True),
    ("diversion", True),
    ("other", True),
    ("unknown", False),
]
SENTENCING_CATEGORIES = [
    ("probation", True),
    ("incarceration", True),
    ("fine", True),
    ("restitution", True),
    ("community_service", True),
    ("no_further_penalty", True),
    ("costs_fees", True),
    ("other", True),
    ("unknown", False),
]
CONVICTIONS = ["guilty_plea", "guilty_verdict"]
MONETARY = ["fine", "costs_fees", "restitution"]
UNKNOWN = "unknown"

HELD_FORMS = [
    "Held for Court",
    "IGJ - Held for Court",
    "HP - Held for Court",
    "Held for Court IC",
    "GJ - Held for Court",
    "Held for Court - Hearsay",
    "Held for Court - Pre-TCY",
    "Held for Court - In Absentia",
]
DISPOSITIONS = {
    "guilty_plea": [
        "Guilty Plea - Negotiated",
        "Guilty Plea - Non-Negotiated",
        "Guilty Plea - Negotiated IC",
        "Guilty Plea",
        "Nolo Contendere",
        "Guilty Plea - Non-Negotiated IC",
        "Guilty Plea IC",
        "Nolo Contendere/Probation",
        "Guilty Plea - Mentally Ill",
    ],
    "guilty_verdict": ["Guilty", "Guilty IC"],
    "dismissed": [
        "Nolle Prossed",
        "Quashed",
        "Dismissed - LOE",
        "Dismissed - Rule 600 (Speedy Trial)",
        "Dismissed",
        "Dismissed - LOP",
        "Dismissed - Rule 1013",
        "Dismissed - Rule 586",
        "Dismissed - Rule 546",
        "Dismissed - Abatement",
        "Dismissed - De Minimis",
        "Nolle Prossed IC",
        "Quashed IC",
        "Dismissed - Abatement IC",
        "Dismissed - LOP IC",
        "Dismissed - LOE IC",
    ],
    "acquittal": ["Not Guilty", "Judgment of Acquittal", "Judgment of Acquittal IC", "Not Guilty IC"],
    "ard": ["ARD - County"],
    "withdrawn": ["Withdrawn", "Withdrawn IC"],
    "other": [
        "Transferred to Another Jurisdiction",
        "Mistrial - Hung Jury",
        "Mistrial",
        "Charge Changed (Lower Court)",
        "Transferred to Juvenile Division",
    ],
}
SENTENCE_TYPES = {
    "Confinement": "incarceration",
    "Probation": "probation",
    "No Further Penalty": "no_further_penalty",
    "ARD": "other",
    "Fines and Costs": "costs_fees",
    "IPP": "other",
}
NO_DURATION_TYPES = ["no further penalty", "fines and costs"]
TRUNCATED_DISPOSITIONS = {
    "Transferred to Another": "Transferred to Another Jurisdiction",
    "Dismissed - Rule 600 (Speedy": "Dismissed - Rule 600 (Speedy Trial)",
}
GRADES = ["F1", "F2", "F3", "F", "M1", "M2", "M3", "M", "S", "H1", "H2"]
UNGRADED = "ungraded"

# match methods and normalisation warnings
EXACT, ALIAS, STATUTE, PATTERN, UNMATCHED, AMBIGUOUS = "exact", "alias", "statute", "pattern", "unmatched", "ambiguous"
PUBLIC_METHODS = [EXACT, ALIAS, STATUTE]
NORM_UNMATCHED = "NORM_UNMATCHED"
NORM_AMBIGUOUS = "NORM_AMBIGUOUS"
NORM_EMPTY_INPUT = "NORM_EMPTY_INPUT"
NORM_STATUTE_TEXT_CONFLICT = "NORM_STATUTE_TEXT_CONFLICT"
NORM_UNPARSEABLE_AMOUNT = "NORM_UNPARSEABLE_AMOUNT"
FAKE_JUDGE_SLUGS = ["judge-testina-placeholder", "judge-samuel-seeddata", "judge-fakename-example"]
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv"]

# parser warning code -> severity
WARNING_SEVERITY = {
    "LOW_TEXT_EXTRACTION": "review",
    "MISSING_CHARGE_SECTION": "review",
    "UNSUPPORTED_FORMAT": "review",
    "MISSING_DISPOSITION_DATE": "review",
    "SUSPECT_JUDGE_LINE": "review",
    "SUSPECTED_AMENDED_CHARGE": "review",
    "SENTINEL_COLLISION": "review",
    "UNKNOWN_NOT_FINAL_DISPOSITION": "review",
    "SUSPECT_DISPOSITION_TOKEN": "review",
    "ORPHANED_SENTENCE_SUPPRESSED": "review",
    "UNPARSEABLE_DURATION": "info",
    "MISSING_SENTENCE_DATE": "info",
    "NON_TERMINAL_CASE": "info",
    "BLANK_DOB_CAPTION": "info",
}
CAPTURED_THEN_NULLED = ["SUSPECT_JUDGE_LINE", "SENTINEL_COLLISION"]

REASON_CODES = [
    "disposition_date_missing",
    "disposition_date_before_mvp_window",
    "sentence_date_missing",
    "sentence_date_before_mvp_window",
    "charge_not_normalized",
    "judge_not_normalized",
    "disposition_not_mapped",
    "outcome_category_not_public",
    "sentencing_category_not_public",
    "sentencing_component_not_normalized",
    "review_needed",
    "blocking_warning",
    "judge_not_attributed",
    "parent_outcome_ineligible",
    "money_amount_unparseable",
    "sentence_duration_unparseable",
    "filed_date_before_floor",
    "filed_date_missing",
]

# sheet sections, and lines of the disposition section that are only headings
SECTIONS = [
    "CASE INFORMATION",
    "RELATED CASES",
    "STATUS INFORMATION",
    "CALENDAR EVENTS",
    "DEFENDANT INFORMATION",
    "CASE PARTICIPANTS",
    "BAIL INFORMATION",
    "CHARGES",
    "DISPOSITION SENTENCING/PENALTIES",
    "COMMONWEALTH INFORMATION",
    "ATTORNEY INFORMATION",
    "CASE FINANCIAL INFORMATION",
    "ENTRIES",
]
DISPOSITION_HEADINGS = [
    "DISPOSITION SENTENCING/PENALTIES",
    "Disposition",
    "Case Event Disposition Date Final Disposition",
    "Sequence/Description Offense Disposition Grade Section",
    "Sentencing Judge Sentence Date Credit For Time Served",
    "Sentence/Diversion Program Type Incarceration/Diversionary Period Start Date",
    "Sentence Conditions",
]
PAGE_FURNITURE = [
    "COURT OF COMMON PLEAS OF PHILADELPHIA COUNTY",
    "MUNICIPAL COURT OF PHILADELPHIA COUNTY",
    "DOCKET",
    "CRIMINAL DOCKET",
    "Court Case",
    "Commonwealth of Pennsylvania",
]
DISCLAIMERS = [
    "Recent entries made in the court",
    "Neither the courts of the Unified Judicial",
    "System of the Commonwealth of Pennsylvania",
    "data, errors or omissions on these reports",
    "only be provided by the Pennsylvania State Police",
    "Moreover an employer who does not comply",
    "Information Act may be subject to civil liability",
]
ARD_CLASS = ["ARD - County", "RD - County"]
NON_TERMINAL = [
    "ARD - County Open",
    "Added by Information",
    "DUI: High Rte of Alc (Bac.10 - <.16) 1st Off Held for Court M 75 § 3802 §§ B*",
    "DUI: High Rte of Alc (Bac.10 - <.16) 1st Off Proceed to Court M 75 § 3802 §§ B*",
    "DUI: Highest Rte of Alc (BAC .16+) 1st Off Held for Court M 75 § 3802 §§ C*",
    "DUI: Highest Rte of Alc (BAC .16+) 1st Off Proceed to Court M 75 § 3802 §§ C*",
    "Dismissed - LOE",
    "Dismissed - Rule 600 (Speedy",
    "Guilty",
    "Guilty Plea - Negotiated",
    "Guilty Plea - Non-Negotiated",
    "HP - Held for Court",
    "Held for Court",
    "Held for Court IC",
    "IGJ - Held for Court",
    "Mistrial - Hung Jury",
    "Nolle Prossed",
    "Nolo Contendere",
    "Permitting Violation - Accident Involving Damage Held for Court S 75 § 3743 §§ A-P",
    "Permitting Violation - Accident Involving Damage Proceed to Court S 75 § 3743 §§ A-P",
    "Proceed to Court",
    "Proceed to Court (ARD",
    "Proceed to Court (Complaint",
    "Proceed to Court (Conviction",
    "Proceed to Court (GP",
    "Proceed to Court (Mistrial)",
    "Proceed to Court (Program",
    "Proceed to Court IC",
    "Proceed to Ct (Nolle Prossed",
    "Quashed",
    "Replacement by Information",
    "Rule 546 - Open",
    "Rule 586 - Open",
    "ceed to Court",
    "oceed to Court",
    "roceed to Court",
]
ASSOCIATION_REASONS = [
    "Consolidated Defendant Cases Number and Primary Participant",
    "Joined Codefendant Cases Number and Different Primary Participant",
    "Consolidated Defendant Cases",
    "Joined Codefendant Cases",
    "Refiled",
    "Related",
    "Consolidated",
    "Joined",
]

# public copy: forbidden term -> pattern, and the only phrases that may hold such words
FORBIDDEN_TERMS = {
    "odds": r"\bodds\b",
    "predict stem": r"\bpredict(?:s|ed|ing|ions?|ive)?\b",
    "guarantee stem": r"\bguarantee(?:s|d|ing)?\b",
    "likely sentence": r"\blikely sentence\b",
    "best judge": r"\bbest judge\b",
    "worst judge": r"\bworst judge\b",
    "judge score": r"\bjudge score\b",
    "win rate": r"\bwin rate\b",
    "harsher": r"\bharsher\b",
    "more lenient": r"\bmore lenient\b",
}
GUARDED_PHRASES = [
    "not a prediction",
    "not predictions",
    "do not predict",
    "does not predict",
    "not legal advice",
    "does not provide legal advice",
]

# collector
#: Types of review items (and, after a stroke, their cases): severity, reason and kind of entity.
REVIEW_ITEMS = {
    "unmapped_charge": ("medium", "charge_not_normalized", "charge"),
    "ambiguous_charge": ("medium", "charge_not_normalized", "charge"),
    "ambiguous_charge/conflict": ("high", "blocking_warning", "charge"),
    "unmapped_disposition": ("medium", "disposition_not_mapped", "disposition"),
    "unmapped_sentencing_component": ("medium", "sentencing_component_not_normalized", "sentencing"),
    "ambiguous_sentencing_component": ("medium", "sentencing_component_not_normalized", "sentencing"),
    "money_unparseable": ("low", "money_amount_unparseable", "sentencing"),
    "duration_unparseable": ("low", "sentence_duration_unparseable", "sentencing"),
    "additive_sentencing_category": ("low", "review_needed", "sentencing"),
    "missing_disposition_date": ("medium", "disposition_date_missing", "disposition"),
    "sentinel_collision": ("medium", "judge_not_normalized", "judge"),
    "unresolvable_cross_court_reference": ("medium", "review_needed", None),
}

STREAK_STOP = 5
COVERAGE_FLOORS = [1, 2, 3, 5, 10, 20, 50]
