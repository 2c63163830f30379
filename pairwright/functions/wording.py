"""The wording of every rendered text.

These strings decide what is embedded, so they must stay exactly as they are.
``{name}`` marks a slot that is filled with a column.
"""

# Task prefixes of the embedding model.
DOCUMENT_PREFIX = "search_document: "
QUERY_PREFIX = "search_query: "

# Major of a student who has none.
UNDECLARED_MAJOR = "Undeclared"

# Skill document.
SKILL_DOCUMENT = "Technical and professional competency skill: {name}"

# Student document and its fallbacks.
STUDENT_DOCUMENT = (
    "Student Profile: {full_name}. "
    "Primary Academic Major Path: {major_name}. "
    "Sub-Track Concentrations: {specialties}. "
    "Technical Competency Skill Matrix: {skills}. "
    "Personal Background and Career Aspirations: {about}"
)
STUDENT_NO_SPECIALTIES = "No specialized sub-tracks designated"
STUDENT_NO_SKILLS = "No technical skills indexed yet"
STUDENT_NO_ABOUT = "No professional biography or summary provided."

# Professor document and its fallbacks.
PROFESSOR_DOCUMENT = (
    "Academic Faculty Professor Profile: {full_name}. "
    "Department Division: {department}. "
    "Institutional Rank: {rank}. "
    "Active Research Interest Domains: [{interests}]. "
    "Biography, Research Focus, and Lab Direction: {about}"
)
PROFESSOR_NO_INTERESTS = "General academic supervision and instruction"
PROFESSOR_NO_ABOUT = "No professional biography or lab summary provided."

# Project document, its optional part and its fallbacks.
PROJECT_DOCUMENT = (
    "Academic Project Assignment Blueprint. "
    "Project Title: {title}. "
    "Core Description, Scope, and Deliverable Objectives: {description} "
    "Academic Requirements: {major}{specialty} "
    "Required Student Technical Competencies: [{skills}]."
)
PROJECT_MAJOR = "Targeted primarily toward {major_name} academic paths."
PROJECT_NO_MAJOR = "Open to all general majors."
PROJECT_SPECIALTY = " Aligned with the {specialty_name} specialization track."
PROJECT_NO_SKILLS = "General cross-functional capabilities"

# Query of a student looking for projects.
PROJECT_QUERY = (
    "Find academic project assignment blueprints and research opportunities that strongly align "
    "with a student majoring in {major_name}, pursuing concentrations in [{specialties}], "
    "who possesses technical expertise in [{skills}], and is deeply interested in: {about}"
)
PROJECT_QUERY_NO_SPECIALTIES = "general curriculum studies"
PROJECT_QUERY_NO_SKILLS = "foundational academic concepts"
PROJECT_QUERY_NO_ABOUT = "practical applied learning experiences"

# Query of a student looking for skills.
SKILL_QUERY = (
    "Identify complementary industry skills, technical frameworks, or professional competencies "
    "that are highly relevant or a natural progression for a {major_name} student{specialties} "
    "who currently knows [{skills}].{about}"
)
SKILL_QUERY_SPECIALTIES = " specializing in {names}"
SKILL_QUERY_NO_SKILLS = "beginner academic tracks"
SKILL_QUERY_ABOUT = " Career focus: {about}"

# Query of a project looking for an advisor.
ADVISOR_QUERY = (
    "Identify an academic faculty professor and research advisor{major}{specialty} "
    "whose expert research interests, industry backgrounds, and current lab direction "
    "directly align with supervising a student project titled '{title}'. "
    "The project entails: {description} "
    "The supervisor should have background relevant to these student competencies: [{skills}]."
)
ADVISOR_MAJOR = " in the {major_name} department"
ADVISOR_SPECIALTY = " focusing on {specialty_name}"
ADVISOR_NO_SKILLS = "academic research methods"

# The 29 code points that count as white space when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
