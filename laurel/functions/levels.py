"""Category lists shared by every report.

Fixed values: codes, labels and their order have to equal the ones the reports
have always shown, so they are written out here once, in display order.
"""

AWARD_NAMES = {
    "CS": "Skills Certificate",
    "C": "Certificate of Achievement",
    "AA": "Associate in Arts",
    "AS": "Associate in Science",
    "AT": "Associate in Arts for Transfer",
    "ST": "Associate in Science for Transfer",
    "CN": "Noncredit Certificate",
}
UNKNOWN_AWARD = "Unknown award type"

GENDERS = ["Male", "Female"]

ETHNICITIES = [
    "Asian",
    "Black/African American",
    "Hawaiian/Pacific Islander",
    "Hispanic/Latino",
    "Native American",
    "Two or more races",
    "Unknown",
    "White",
]

ETHNICITY_GENDERS = [f"{ethnicity} {gender}" for ethnicity in ETHNICITIES for gender in GENDERS]

SEASONS = ["Winter", "Spring", "Summer", "Fall"]  # position = last digit of a term code
SEASON_ORDER = ["Summer", "Fall", "Winter", "Spring"]  # order within an academic year

SGEC_STATUSES = ["Not an SGEC student", "SGEC student"]
ONLINE_STATUSES = ["Not an online student", "Online student"]

PASSING_GRADES = ["A", "B", "C", "P"]
DROPPED_GRADE = "E"

SPECIAL_COURSES = [
    "MATH 105", "MATH 110", "MATH 112", "MATH 115", "MATH 125",
    "ENGLISH 019", "ENGLISH 021", "ENGLISH 026", "ENGLISH 028",
    "READING 019", "READING 020",
]

ALL_COMPLETERS = "All completers"
SIX_YEAR_COHORT = "Six-year cohort"
ALL_STUDENTS = "All Students"
