"""Word lists, lookup tables and limits.

Everything in this file is a FIXED VALUE: results are only right when these
lists equal the published ones, so they are written out plainly and in their
natural order.  Logic lives elsewhere.
"""

from __future__ import annotations


def _terms(text: str) -> list[str]:
    return [t.strip() for t in text.replace("\n", " ").split(",") if t.strip()]


def _table(text: str) -> dict[str, list[str]]:
    out = {}
    for line in text.strip().splitlines():
        key, _, rest = line.strip().partition(":")
        out[key.strip()] = _terms(rest)
    return out


# --------------------------------------------------------------------------
# Location (fixed values)
# --------------------------------------------------------------------------

REMOTE_TERMS = _terms("""
remote, work from home, work-from-home, wfh, telecommute, telework, virtual,
anywhere, distributed, fully remote, 100% remote, location independent, online
""")

HYBRID_TERMS = _terms("""
hybrid, partially remote, partly remote, flexible location, remote-friendly,
remote friendly, some remote, blended
""")

ONSITE_TERMS = _terms("""
on-site, onsite, on site, in-person, in person, in-office, in office,
office-based, office based, at our office
""")

GLOBAL_TERMS = _terms("""
worldwide, global, international, any country, anywhere in the world,
no location restriction, location agnostic, open to all countries
""")

HOME_NAMES = _terms("india, indian, bharat, hindustan")

HOME_CITIES = _terms("""
bangalore, bengaluru, blr, hyderabad, hyd, secunderabad, mumbai, bombay,
navi mumbai, thane, pune, pimpri, delhi, new delhi, ncr, noida,
greater noida, gurgaon, gurugram, faridabad, ghaziabad, chennai, madras,
kolkata, calcutta, ahmedabad, gandhinagar, surat, vadodara, baroda, rajkot,
jaipur, udaipur, jodhpur, kota, lucknow, kanpur, varanasi, prayagraj,
allahabad, agra, indore, bhopal, gwalior, jabalpur, raipur, nagpur, nashik,
aurangabad, kolhapur, solapur, kochi, cochin, ernakulam, trivandrum,
thiruvananthapuram, kozhikode, calicut, thrissur, kollam, coimbatore,
madurai, trichy, tiruchirappalli, salem, vellore, erode, tirupur, thanjavur,
visakhapatnam, vizag, vijayawada, guntur, tirupati, nellore, mysore, mysuru,
mangalore, mangaluru, hubli, belgaum, chandigarh, mohali, ludhiana, amritsar,
jalandhar, patiala, dehradun, haridwar, roorkee, shimla, bhubaneswar,
cuttack, rourkela, puri, patna, ranchi, jamshedpur, dhanbad, bokaro,
guwahati, shillong, imphal, agartala, aizawl, goa, panaji, vasco, margao,
jammu, srinagar, leh, warangal, karimnagar, nizamabad, pilani, kharagpur,
kanpur nagar, manipal, vellore institute
""")

HOME_REGIONS = _terms("""
andhra pradesh, arunachal pradesh, assam, bihar, chhattisgarh, goa, gujarat,
haryana, himachal pradesh, jharkhand, karnataka, kerala, madhya pradesh,
maharashtra, manipur, meghalaya, mizoram, nagaland, odisha, orissa, punjab,
rajasthan, sikkim, tamil nadu, tamilnadu, telangana, tripura, uttar pradesh,
uttarakhand, west bengal, delhi ncr, andaman, nicobar, chandigarh, dadra,
nagar haveli, daman, diu, lakshadweep, puducherry, pondicherry, ladakh,
jammu and kashmir, jammu & kashmir
""")

US_STATE_CODES = _terms("""
AL, AK, AZ, AR, CA, CO, CT, DE, FL, GA, HI, ID, IL, IN, IA, KS, KY, LA, ME,
MD, MA, MI, MN, MS, MO, MT, NE, NV, NH, NJ, NM, NY, NC, ND, OH, OK, OR, PA,
RI, SC, SD, TN, TX, UT, VT, VA, WA, WV, WI, WY, DC, PR
""")

US_STATE_NAMES = _terms("""
alabama, alaska, arizona, arkansas, california, colorado, connecticut,
delaware, florida, georgia, hawaii, idaho, illinois, indiana, iowa, kansas,
kentucky, louisiana, maine, maryland, massachusetts, michigan, minnesota,
mississippi, missouri, montana, nebraska, nevada, new hampshire, new jersey,
new mexico, new york, north carolina, north dakota, ohio, oklahoma, oregon,
pennsylvania, rhode island, south carolina, south dakota, tennessee, texas,
utah, vermont, virginia, washington, west virginia, wisconsin, wyoming,
district of columbia, puerto rico
""")

US_CITIES = _terms("""
new york, nyc, brooklyn, manhattan, san francisco, sf, bay area, palo alto,
mountain view, sunnyvale, san jose, santa clara, cupertino, menlo park,
redwood city, oakland, seattle, bellevue, redmond, portland, los angeles,
la, san diego, irvine, santa monica, austin, dallas, houston, san antonio,
chicago, boston, cambridge, atlanta, denver, boulder, phoenix, tempe,
scottsdale, miami, orlando, tampa, philadelphia, pittsburgh, detroit,
ann arbor, minneapolis, st louis, kansas city, columbus, cleveland,
cincinnati, indianapolis, nashville, charlotte, raleigh, durham,
washington dc, arlington, mclean, reston, baltimore, salt lake city,
las vegas, sacramento, fremont, pleasanton, hoboken, jersey city, newark,
princeton, stamford
""")

# Country code: words that name it; the first listed country wins.
COUNTRY_TERMS = _table("""
US: united states, usa, u.s., u.s.a, america, american
CA: canada, canadian, toronto, vancouver, montreal, ottawa, waterloo, calgary, edmonton, ontario, quebec, british columbia
GB: united kingdom, uk, england, english university, british, london, manchester, birmingham, edinburgh, glasgow, cambridge uk, oxford, bristol, leeds, scotland, wales
DE: germany, german, berlin, munich, münchen, hamburg, frankfurt, stuttgart, cologne, deutschland
FR: france, french, paris, lyon, toulouse, marseille
NL: netherlands, dutch, amsterdam, rotterdam, eindhoven, utrecht
IE: ireland, irish, dublin, cork, galway
CH: switzerland, swiss, zurich, zürich, geneva, lausanne
SE: sweden, swedish, stockholm, gothenburg
PL: poland, polish, warsaw, krakow, kraków, wroclaw
ES: spain, spanish, madrid, barcelona, valencia
IT: italy, italian, milan, rome, turin
SG: singapore, singaporean
AE: dubai, abu dhabi, united arab emirates, uae, sharjah, emirati
AU: australia, australian, sydney, melbourne, brisbane, perth, canberra
NZ: new zealand, auckland, wellington
JP: japan, japanese, tokyo, osaka, kyoto
KR: south korea, korean, seoul, korea
CN: china, chinese, beijing, shanghai, shenzhen, hangzhou, guangzhou
HK: hong kong
TW: taiwan, taiwanese, taipei
IL: israel, israeli, tel aviv, haifa, jerusalem
BR: brazil, brazilian, sao paulo, são paulo, rio de janeiro
MX: mexico, mexican, mexico city, guadalajara, monterrey
AR: argentina, argentinian, buenos aires
ZA: south africa, south african, cape town, johannesburg
NG: nigeria, nigerian, lagos, abuja
KE: kenya, kenyan, nairobi
EG: egypt, egyptian, cairo
PK: pakistan, pakistani, karachi, lahore, islamabad
BD: bangladesh, bangladeshi, dhaka
LK: sri lanka, sri lankan, colombo
NP: nepal, nepali, kathmandu
PH: philippines, filipino, manila, cebu
ID: indonesia, indonesian, jakarta, bandung
MY: malaysia, malaysian, kuala lumpur, penang
TH: thailand, thai, bangkok
VN: vietnam, vietnamese, hanoi, ho chi minh
TR: turkey, turkish, istanbul, ankara
RU: russia, russian, moscow, st petersburg
UA: ukraine, ukrainian, kyiv, kiev, lviv
CZ: czech, prague, brno
RO: romania, romanian, bucharest, cluj
PT: portugal, portuguese, lisbon, porto
AT: austria, austrian, vienna
BE: belgium, belgian, brussels, leuven
DK: denmark, danish, copenhagen
NO: norway, norwegian, oslo
FI: finland, finnish, helsinki
GR: greece, greek, athens
HU: hungary, hungarian, budapest
CL: chile, chilean, santiago
CO: colombia, colombian, bogota, bogotá, medellin
PE: peru, peruvian, lima
SA: saudi arabia, saudi, riyadh, jeddah
QA: qatar, qatari, doha
CR: costa rica, costa rican
""")

# Bare upper-case codes; the four special spellings come first.
BARE_CODE_ALIASES = {"US": "US", "USA": "US", "U.S.": "US", "U.S.A.": "US", "UK": "GB"}
BARE_CODES_SAME = _terms("""
GB, CA, EU, AU, NZ, DE, FR, NL, IE, CH, SE, PL, ES, IT, PT, AT, BE, DK, NO,
FI, CZ, RO, HU, SG, JP, KR, CN, HK, TW, AE, SA, QA, IL, TR, BR, MX, AR, CL,
CO, PE, ZA, NG, KE, EG, PK, BD, LK, NP, PH, ID, MY, TH, VN, RU, UA
""")

AUTH_PHRASES = _table("""
US: us only, u.s. only, usa only, us-based, us based, must be authorized to work in the united states, us work authorization, requires us citizenship, green card, eligible to work in the us, us residents
CA: canada only, canadian residents, must reside in canada
GB: uk only, uk-based, uk based, right to work in the uk
EU: eu only, eu-based, eea, right to work in the eu
""")

HOME_COUNTRY = "IN"
GEO_POLICY = {"remote": "any", "remote_geo": "home", "hybrid": "home", "onsite": "home", "unknown": "keep"}
GEO_CATEGORIES = ["internships", "jobs"]
MODE_LABELS = {"remote": "Remote", "remote_geo": "Remote", "hybrid": "Hybrid",
               "onsite": "In-person", "unknown": "Unspecified"}

# --------------------------------------------------------------------------
# Titles, sources, trust (fixed values)
# --------------------------------------------------------------------------

GENERIC_TOKENS = _terms("""
hackathon, hackathons, challenge, challenges, competition, competitions,
internship, internships, program, programme, fellowship, job, jobs, role,
career, careers, apply, application, applications, online, virtual, hybrid,
remote, global, international, national, annual, season, edition, summer,
winter, spring, fall, autumn, the, and, for, with, from, your, you, all, new,
open, free, tech, technology, software, engineer, engineering, developer,
intern, student, students, university, college, contest, event, hiring,
recruit, recruitment, official, site, home, page, register, registration,
grand, india, world
""")

STOP_WORDS = _terms("the, a, an, of, for, and, in, to, is, on, at, by")

SOURCE_TRUST = {
    "devpost-live-api": 0.95, "mlh-live-events": 0.95, "codeforces": 0.95,
    "leetcode": 0.90, "kontests": 0.85, "hackerearth": 0.80,
    "devfolio": 0.80, "unstop": 0.80, "internshala": 0.75, "jobspy": 0.70,
    "company:": 0.80, "github-": 0.60, "opensource": 0.60, "gsoc": 0.85,
    "reach:rss:": 0.80, "reach:news:": 0.45, "reach:web:": 0.40,
    "reach:search:": 0.30, "reddit:": 0.35, "reddit": 0.35,
    "twitter": 0.30, "x:": 0.30, "reel": 0.25, "instagram": 0.25,
}
DEFAULT_TRUST = 0.50

# --------------------------------------------------------------------------
# Dates and status (fixed values)
# --------------------------------------------------------------------------

CLAIM_NON_DATE = _terms("""
rolling, annual, various, check, tbd, tba, asap, ongoing, continuous, always,
anytime, quarterly, monthly
""")
NEVER_PAST = _terms("rolling, annual, various, check, tbd, tba, asap")
PAST_WORDS = _terms("ended, closed, past, concluded")
CLOSED_DESCRIPTION = _terms("applications closed, hackathon ended, event ended")
REMINDER_SKIP = _terms("rolling, various, check, tbd, tba")
REMINDER_DAYS = [7, 3, 1]
L1_SOFT_DATES = _terms("rolling, annual, check, tbd, tba, various, open, ongoing")
STATUS_MARKS = {"open": "🟢", "closed": "🔴", "coming-soon": "🟡"}

# --------------------------------------------------------------------------
# Layer 1 plausibility (fixed values)
# --------------------------------------------------------------------------

L1_WEIGHTS = {"schema": 0.25, "url": 0.20, "date": 0.15, "content": 0.15, "spam": 0.15, "fuzzy": 0.10}
L1_REJECT, L1_WARN = 0.30, 0.60
PROBE_CAP = 20
JACCARD = 0.85
HARD_SPAM = _terms("""
guaranteed income, guaranteed earning, earn from home, network marketing, mlm,
pyramid scheme, crypto airdrop, free bitcoin, nft drop, web3 airdrop,
whatsapp group, telegram group join, click here to claim,
you have been selected, no experience needed earn, work from home earn
""")
SOFT_SPAM = _terms("""
💰💰💰, 🔥🔥🔥, !!!!, earn money fast, too good to be true,
limited spots act now, referral bonus, refer and earn
""")
CONTENT_GENERIC = _terms("""
hackathon, challenge, competition, internship, program, summer, winter,
online, virtual, free, open, tech, software, engineer, intern, https, http,
with, from
""")

# --------------------------------------------------------------------------
# Layer 2 evidence (fixed values)
# --------------------------------------------------------------------------

EVENT_TYPES = _terms("""
event, hackathon, educationevent, socialevent, businessevent, festival,
courseinstance
""")
POSTING_TYPES = _terms("jobposting, internship")
CHILD_KEYS = ["@graph", "subEvent", "subEvents", "itemListElement", "mainEntity"]
JSONLD_DEPTH = 6

CLOSED_PHRASES = _terms("""
registration is closed, registrations are closed, registration closed,
registrations closed, applications are closed, applications closed,
application closed, submissions are closed, submissions closed,
this hackathon has ended, this event has ended, event has ended,
hackathon has ended, competition has ended, challenge has ended,
no longer accepting, deadline has passed, entries are closed,
this position is no longer, job posting has expired,
posting is no longer available, this opportunity has closed,
winners announced, winners have been announced
""")
ROT_PHRASES = _terms("""
404, page not found, not found, no longer exists, domain is for sale,
buy this domain, parked domain, account suspended, this site can,
coming soon, under construction, expired domain
""")
CHALLENGE_TITLES = _terms("""
security check, just a moment, attention required, access denied,
are you a robot, are you human, verify you are human, captcha,
checking your browser, bot verification, human verification,
unusual traffic, rate limit, too many requests, 403 forbidden, cloudflare,
ddos-guard, please wait, one more step, enable javascript,
javascript is required, verifying you are human
""")
CHALLENGE_BODIES = _terms("""
enable javascript and cookies to continue, verify you are a human,
complete the security check, your request has been blocked,
automated queries, unusual traffic from your computer,
please verify you are a human, checking if the site connection is secure
""")
THIN_PAGE_CHARS = 2000
BREAKER_MIN_ATTEMPTS, BREAKER_RATE = 6, 0.75

QUORUM, TRUST_AUTOPASS, SUSPICION_LIMIT = 2, 0.75, 3
DEADLINE_OVERSHOOT, EVENT_DRIFT = 30, 45
TITLE_HARD, TITLE_SOFT = 0.15, 0.34
PLACEHOLDERS = ["n/a", "na", "none", "null", "tbd", "-", "undefined", "nan"]

# --------------------------------------------------------------------------
# Memory and gate (fixed values)
# --------------------------------------------------------------------------

RECHECK_HOURS = 72
MAX_ATTEMPTS = 4
RETENTION_DAYS = 180
QUARANTINE_CAP = 500
INTERNAL_COLUMNS = [
    "_verification_score", "_verification_warnings", "_rejection_reasons",
    "_adjudication", "_quarantine", "_location_reject", "_research",
]
VALID_STATUSES = ["open", "closed", "coming-soon", "upcoming", "ongoing", ""]
GATE = {
    "retention": 0.90, "surge_abs": 150, "surge_rel": 0.40, "bootstrap": 10,
    "missing_link": 0.35, "duplicate": 0.12, "blank_name": 0.02,
    "link_floor": 20, "link_keep": 0.75,
}

# --------------------------------------------------------------------------
# Faceted search and feature tables (fixed values)
# --------------------------------------------------------------------------

PAGE_SIZE = 36
DOMAINS = _table("""
swe: software, developer, swe, full stack, frontend, backend, web, engineer, c++, python, java, react
ai-ml: ai, machine learning, ml, nlp, vision, deep learning, data science, llm, generative, pytorch
data: data, analytics, analyst, bi, sql, database, tableau, etl, insights
cloud: cloud, devops, sre, aws, azure, gcp, kubernetes, infrastructure, platform
security: security, cyber, infosec, threat, vulnerability, soc, cryptography
mobile: mobile, android, ios, flutter, react native, swift, kotlin
hardware: hardware, embedded, firmware, fpga, asic, vlsi, circuit, semiconductor, silicon
quant: quant, quantitative, trading, trader, algorithm, financial, derivatives, market
pm-design: product, design, ui, ux, pm, program manager, scrum
""")
EUROPE = _terms("GB, DE, FR, NL, IE, CH, SE, PL, ES, IT, PT, AT, BE, DK, NO, FI, CZ, RO, HU, GR, EU")
LOCATION_HINTS = _table("""
remote: remote, online, virtual, work from home, wfh, anywhere
india: india, bengaluru, bangalore, delhi, ncr, noida, gurgaon, gurugram, hyderabad, pune, chennai, mumbai, kolkata, ahmedabad, kochi, coimbatore, jaipur, indore
usa: united states, usa, new york, san francisco, seattle, austin, boston, chicago, los angeles
canada: canada, canadian, toronto, vancouver, montreal, waterloo
europe: europe, united kingdom, england, london, germany, berlin, munich, france, paris, amsterdam, netherlands, dublin, ireland
""")
LEVELS = _table("""
summer: summer
new-grad: new grad, entry level, junior, graduat
research: research, fellowship, phd
open-source: open source, gsoc, lfx, mentorship
""")
PAID_MARKS = ["$", "₹", "paid", "stipend", "salary", "cash"]
MODE_HINTS = _table("""
online: online, virtual, remote
in-person: in-person, onsite, offline, in person
hybrid: hybrid
""")
CHIPS = _table("""
remote: remote, online
india: india
faang: google, microsoft, amazon, apple, meta, nvidia, amd, netflix, goldman, spacex
ai: ai, machine learning, ml
new-grad: new grad, entry level, junior
summer: summer
paid: $, ₹, stipend, paid
""")
RESUME_STOP = _terms("and, the, for, with, from, this, that, have")
RESUME_TECH = _terms("""
python, react, machine learning, ai, cloud, aws, backend, full stack,
pytorch, c++, java, sql, docker
""")
FEATURED_EMPLOYERS = _terms("""
google, microsoft, amd, goldman, datadog, isro, mitacs, bny, sage, springs,
westinghouse
""")
CASH_PATTERN = r"(?i)(\$|₹|USD|INR|cash|\b[0-9]{2,3},[0-9]{3}\b|\b[0-9]{5,}\b)"
STIPEND_PATTERN = r"(?i)(\$|₹|CAD|EUR|stipend|grant|month|salary)"
CATEGORIES = ["hackathons", "internships", "jobs", "competitions", "open-source-programs", "fellowships"]
FEATURE_LIMITS = {"hackathons": 12, "internships": 12, "jobs": 12, "competitions": 8,
                  "open-source-programs": 12, "fellowships": 8}

# --------------------------------------------------------------------------
# Sources (fixed values)
# --------------------------------------------------------------------------

POST_KEYWORDS = _terms("""
hackathon, internship, fellowship, open source program, registration open,
application deadline, apply now, stipend, coding competition, gsoc, mlh,
prize pool, cash prize, hiring, new grad, buildathon, bounty, challenge,
designathon
""")
STRONG_NEWS = _terms("""
hackathon, hack-a-thon, buildathon, codefest, datathon, ideathon,
designathon, summer of code, fellowship, internship, scholarship, olympiad,
capture the flag
""")
WEAK_NEWS = _terms("challenge, competition, contest, grant, bounty, sprint, jam, award, prize")
APPLY_SIGNALS = _terms("""
applications are open, applications open, application is open, apply now,
apply by, apply before, now accepting, registration is open,
registrations are open, registration open, register now,
submissions are open, submissions open, call for, nominations are open,
nominations open, sign-ups are open, signups are open, enter by, deadline,
eligible students, cash prize, prize pool
""")
LISTING_HINTS = _terms("""
hackathon, hack, buildathon, codefest, datathon, ideathon, designathon,
challenge, competition, contest, sprint, jam, fellowship, internship,
scholarship, grant, bounty, summit, conference, olympiad, quiz, case study,
innovation
""")
NAV_WORDS = _terms("""
home, login, log in, sign in, sign up, register, about, contact, privacy,
terms, blog, careers, help, support, faq, pricing, docs, documentation, next,
previous, more, read more, learn more, view all, see all, back, menu, search,
filter, sort, share, download, apply, apply now, cookie policy, sitemap,
advertise, press, team, features
""")
JOB_TITLE_TERMS = _terms("engineer, developer, intern, software, ai, data")
NAME_HEADERS = ["name", "event", "program", "company", "organisation", "organization"]
TABLE_NAME_REJECT = _terms("""
name, event, program, company, ---, month, january, february, march, april,
may, june, july, august, september, october, november, december
""")
POST_CATEGORY = {
    "hackathons": ["hackathon", "hack ", "hacks", "buildathon", "devpost", "devfolio"],
    "internships": ["internship", "intern", "hiring", "job", "summer 202", "swe intern"],
    "open-source-programs": ["gsoc", "lfx", "open source", "outreachy", "github accelerator"],
    "fellowships": ["fellowship", "grant", "scholarship"],
}
SOCIAL_CATEGORY = {
    "hackathons": ["hackathon", "hack ", "buildathon", "makeathon"],
    "internships": ["internship", "intern ", "summer training"],
    "fellowships": ["fellowship", "fellow "],
    "open-source-programs": ["gsoc", "open source program", "mentorship program", "outreachy", "lfx"],
    "competitions": ["competition", "contest", "challenge", "competitive programming"],
}
DEADLINE_PATTERNS = [
    r"(?i)deadline[:\s]+([A-Za-z]+ \d{1,2}(?:st|nd|rd|th)?,? \d{4})",
    r"(?i)deadline[:\s]+(\d{4}-\d{2}-\d{2})",
    r"(?i)apply by[:\s]+([A-Za-z]+ \d{1,2}(?:st|nd|rd|th)?,? \d{4})",
    r"(?i)last date[:\s]+([A-Za-z]+ \d{1,2}(?:st|nd|rd|th)?,? \d{4})",
]
REWARD_PATTERNS = [
    r"(?i)(?:prize|prizes|prize pool)[:\s]+([$₹€£\p{L}\p{N}_\s,.]+?)(?:\.|\n|\z)",
    r"(?i)stipend[:\s]+([$₹€£\p{L}\p{N}_\s,.]+?)(?:\.|\n|\z)",
    r"(?i)(\$[\d,]+(?:\s*(?:k|usd|cash))?)",
    r"(?i)(₹[\d,]+(?:\s*(?:lakh|k|inr))?)",
]
POST_URL_PATTERNS = [
    r"(?i)https?://(?:www\.)?devfolio\.co/\S+",
    r"(?i)https?://(?:www\.)?unstop\.com/\S+",
    r"(?i)https?://(?:www\.)?hackerearth\.com/\S+",
    r"(?i)https?://(?:www\.)?mlh\.io/\S+",
    r"(?i)https?://(?:www\.)?devpost\.com/\S+",
    r"(?i)https?://(?:www\.)?lu\.ma/\S+",
    r"(?i)https?://forms\.gle/\S+",
    r"(?i)https?://(?:www\.)?summerofcode\.withgoogle\.com\S*",
    r"(?i)https?://(?:www\.)?mentorship\.lfx\.linuxfoundation\.org\S*",
    r"(?i)https?://\S+(?:apply|register|signup|sign-up|careers|jobs|hackathon|internship)\S*",
]
