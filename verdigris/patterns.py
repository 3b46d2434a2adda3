"""Patterns of the printed forms.

Fixed values: they say what counts as a match, so they are stated as they are, together.
"""

# docket numbers
DOCKET_NUMBER = r"(?:CP|MC)-51-CR-\d{7}-\d{4}"
ANY_DOCKET_NUMBER = r"(?:CP|MC)-\d{2}-[A-Z]{2}-\d{7}-\d{4}"
DOCKET_STEM = r"^(CP|MC)-(\d{2})-[A-Z]{2}-\d{7}-\d{4}$"

# money, durations and sentences
MONEY = r"\$\d{1,3}(?:,\d{3})+(?:\.\d{2})?|\$\d+\.\d{2}|\$\d+"
DURATION = r"(?i)(\d+(?:\.\d+)?)(\s*1/2)?\s+(years?|months?|days?)"
MINIMUM = r"(?i)Min of\s+(.*?)(?:Max of|$|,)"
MAXIMUM = r"(?i)Max of\s+(.*?)(?:Min of|$|,)"
RESTITUTION = r"(?i)\bRestitution\b"
COMMUNITY_SERVICE = r"(?i)\bCommunity Service\b"
HOURS = r"(?i)\b\d+\s*hours?\b"

# what a judge's name cannot be, and what says that a charge was changed
JUNK_JUDGE = [
    r"(?i)\b(?:Confinement|Probation|IPP)\b",
    r"(?i)\b(?:Min|Max)\s+of\b",
    r"(?i)\b\d+(?:\.\d+)?\s*(?:½|1/2)?\s*(?:years?|months?|days?)\b",
    r"\$|\b\d[\d,]*\.\d{2}\b",
]
AMENDED = [r"(?i)\bamended\b", r"(?i)\bdowngraded\b", r"(?i)\breplaced\s+by\b", r"(?i)\bcharge\s+changed\b"]
HONORIFICS = r"(?i)^(?:(?:the\s+)?(?:hon(?:ora(?:ble|ur)?)?\.?|honou?rable|judge|justice)\s+)+"
ROMAN = r"^(?i:i|ii|iii|iv|v|vi|vii|viii|ix|x)$"

# lines of a sheet
PAGE_NUMBER = r"^Page \d+ of \d+$"
PRINTED = r"(?i)^CPCMS .* Printed:.*$"
DEFENDANT = r"^Defendant\s+(.*)$"
BORN = r"(?i)Date\s+of\s+Birth:\s*([\d/]+)"
AFTER_BIRTH_LABEL = r"(?s)Date\s+[Oo]f\s+Birth:(.*)$"
FULL_DATE = r"\d{1,2}/\d{1,2}/\d{4}"
STATUS = r"(?i)Case\s+Status:\s*(.*?)(?:\s+Status\s+Date|\s+Processing|\s+Arrest|$)"
ASSIGNED = r"(?i)Judge\s+Assigned:\s*(.*?)\s+Date\s+Filed:"
FILED = r"(?i)Date\s+Filed:\s*([\d/]+)"
OTN = r"(?i)OTN:\s*([A-Za-z0-9\s-]+?)(?:\s+LOTN:|\s+Originating|$)"
ORIGINATING = rf"(?i)Originating\s+Docket\s+No[.:]*\s*({ANY_DOCKET_NUMBER})"
CROSS_COURT = r"(?i)Cross\s+Court\s+Docket\s+Nos:\s*(.*)$"
DISTRICT_CONTROL = r"^District Control Number\s+(\S+)"
CHARGE_ROW = r"^(\d+)\s+(\d+)\s+(.*)$"
OFFENSE_DATE = r"^\d{2}/\d{2}/\d{4}$"
EVENT = r"(\d{2}/\d{2}/\d{4})\s+(?:Final Disposition|Not Final)$"
CHARGE_LINE = r"^(\d+)\s*/\s*(.*)$"
CONDITION_DATE = r"^\d{1,2}/\d{1,2}/\d{2,4}(?!\d)"
JUDGE_LINE = r"^(.*?)\s+(\d{2}/\d{2}/\d{4})$"
DATE_LAST = r"\d{2}/\d{2}/\d{4}$"
