"""Tracker rule base, templates, categories and request patterns.

The rule base is small and fixed in size (56 rules), so every operator that uses
it inlines it as literal columns: it needs neither a join nor a shuffle. Pass
your own ``Rule`` list to the classifiers to replace it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The tracker rules, in match order.
# key | name | vendor | category | default action | patterns | cookies | strip fields
TRACKER_ROWS = """
ga4 | Google Analytics 4 | Google | analytics | strip | google-analytics.com analytics.google.com region1.google-analytics.com googletagmanager.com | _ga _ga_ _gid _gat _gat_UA _dc_gtm_ __utma __utmb __utmc __utmz __utmt | client_id user_id ip_override user_properties
ga_signals | Google Analytics (Signals) | Google | analytics | strip | google-analytics.com/g/collect | _ga _gid | client_id user_id
piwik_pro | Piwik PRO | Piwik PRO | analytics | strip | piwik.pro .piwik.pro piwikpro.com piwik.app .containers.piwik.pro | _pk_id _pk_ses _pk_ref _pk_cvar _pk_hsr ppms_privacy_ stg_traffic_source_priority stg_last_interaction stg_returning_visitor stg_externalReferrer | _id uid cid cip token_auth e_c e_a e_n dimension1 dimension2 dimension3 pk_cid res ua lang
matomo | Matomo (Piwik OSS) | Matomo | analytics | strip | matomo.php piwik.php matomo.js piwik.js matomo.cloud .matomo.cloud | _pk_id _pk_ses _pk_ref _pk_cvar _pk_hsr mtm_consent mtm_cookie_consent | _id uid cid cip token_auth res ua lang pk_cid
adobe_analytics | Adobe Analytics (Experience Cloud) | Adobe | analytics | strip | .sc.omtrdc.net sc.omtrdc.net /b/ss/ data.adobedc.net .data.adobedc.net adobedc.net demdex.net everesttech.net adobe.com/b/ss | s_cc s_sq s_vi s_fid s_ecid AMCV_ AMCVS_ mbox mboxEdgeCluster at_check | vid aid mid fid c_ip ip aamlh aamb mcorgid callback d_cid d_mid email eVar pe
adobe_target | Adobe Target | Adobe | analytics | strip | tt.omtrdc.net .tt.omtrdc.net | mbox mboxEdgeCluster at_check | mboxMCGVID mboxMCGLH vst. profile.
snowplow | Snowplow | Snowplow | analytics | strip | /com.snowplowanalytics.snowplow/ collector. snplow. /i? sp.js sp.pixel | _sp_id _sp_ses sp | uid duid sid nuid ip eid url refr
tealium | Tealium | Tealium | analytics | strip | tags.tiqcdn.com collect.tealiumiq.com .tealiumiq.com datacloud.tealiumiq.com | utag_main trace_id | tealium_visitor_id uid email ut.visitor_id
contentsquare | Contentsquare / Hotjar Heatmaps | Contentsquare | analytics | block | contentsquare.net t.contentsquare.net c.contentsquare.net cs.contentsquare.com | _cs_id _cs_s _cs_c _cs_ex | uid pid
economic_kvk | Economic / Visitor Queue (NL B2B) | various | analytics | block | leadinfo.net l.leadinfo.net cdn.leadinfo.net snitcher.com app.snitcher.com | _li_id leadinfo | uid company_id
mixpanel | Mixpanel | Mixpanel | analytics | block | api.mixpanel.com cdn.mxpnl.com | mp_ __mp_opt_in_out_ | distinct_id $user_id
amplitude | Amplitude | Amplitude | analytics | block | api.amplitude.com api2.amplitude.com | amplitude_id amplitude_unsent | device_id user_id
segment | Segment | Twilio | analytics | block | api.segment.io cdn.segment.com analytics.js | ajs_user_id ajs_anonymous_id | userId anonymousId
hotjar | Hotjar | Hotjar | analytics | block | static.hotjar.com vars.hotjar.com vc.hotjar.io ask.hotjar.io | _hjid _hjSession _hjTLDTest _hjAbsoluteSessionInProgress _hjIncludedInPageviewSample _hjFirstSeen |
chartbeat | Chartbeat | Chartbeat | analytics | block | static.chartbeat.com ping.chartbeat.net | _cb _cb_ls _chartbeat2 _cb_svref |
comscore | Comscore / ScoreCard Research | comScore | analytics | block | scorecardresearch.com beacon.scorecardresearch.com | UID UIDR |
microsoft_clarity | Microsoft Clarity | Microsoft | analytics | block | clarity.ms www.clarity.ms | _clck _clsk CLID ANONCHK |
new_relic | New Relic | New Relic | analytics | block | bam.nr-data.net js-agent.newrelic.com | |
datadog | Datadog | Datadog | analytics | block | browser-intake-datadoghq.com browser-intake-datadoghq.eu | _dd_s |
fullstory | FullStory | FullStory | analytics | block | fullstory.com rs.fullstory.com edge.fullstory.com | fs_uid fs_lua |
quantcast | Quantcast | Quantcast | analytics | block | quantserve.com pixel.quantserve.com | mc __qca |
parsely | Parse.ly | Parse.ly | analytics | block | parsely.com p1.parsely.com srv.pixel.parsely.com | _parsely_visitor _parsely_session |
yandex_metrika | Yandex Metrika | Yandex | analytics | block | mc.yandex.ru mc.yandex.com an.yandex.ru | _ym_uid _ym_d _ym_isad _ym_visorc yabs-sid |
piano_analytics | Piano Analytics (AT Internet) | Piano Software | analytics | block | piano.io atinternet.com xiti.com | atuserid atidvisitor |
mparticle | mParticle | mParticle | analytics | block | mparticle.com jssdks.mparticle.com | mprtcl-api mprtcl-v4 |
heap | Heap Analytics | Contentsquare | analytics | block | heapanalytics.com cdn.heapanalytics.com | _hp2_id _hp2_ses_props |
pendo | Pendo | Pendo | analytics | block | pendo.io cdn.pendo.io data.pendo.io | |
wordpress_stats | WordPress Stats / Jetpack | Automattic | analytics | block | stats.wp.com pixel.wp.com | |
meta_pixel | Meta Pixel (Facebook/Instagram) | Meta | advertising | block | connect.facebook.net www.facebook.com/tr facebook.com/tr graph.facebook.com | _fbp _fbc fr datr sb xs | fbp fbc external_id
google_ads | Google Ads / DoubleClick | Google | advertising | block | googleads.g.doubleclick.net www.googleadservices.com pagead2.googlesyndication.com tpc.googlesyndication.com adservice.google.com | IDE ANID __gads __gpi NID AID DSID FLC RUL |
tiktok | TikTok Pixel / Analytics | ByteDance | advertising | block | analytics.tiktok.com ads.tiktok.com business.tiktok.com | _ttp _tt_enable_cookie _tt_uid |
linkedin_ads | LinkedIn Insight Tag | Microsoft | advertising | block | snap.licdn.com px.ads.linkedin.com dc.ads.linkedin.com | li_sugr bcookie li_gc UserMatchHistory AnalyticsSyncHistory lms_ads lms_analytics |
microsoft_ads | Microsoft Advertising (Bing Ads) | Microsoft | advertising | block | bat.bing.com universal.bing.com | _uetsid _uetvid MR MUID |
criteo | Criteo | Criteo | advertising | block | static.criteo.net dis.criteo.com gum.criteo.com | uid optout cto_bundle cto_optout |
taboola | Taboola | Taboola | advertising | block | trc.taboola.com cdn.taboola.com nr-data.taboola.com | taboola_session_id trc_cookie_storage |
outbrain | Outbrain | Outbrain | advertising | block | widgets.outbrain.com log.outbrain.com amplify.outbrain.com | obuid |
tradedesk | The Trade Desk | The Trade Desk | advertising | block | js.adsrvr.org match.adsrvr.org pixel.adsrvr.org | TDID TDCPM TTDOptOut |
amazon_ads | Amazon Advertising | Amazon | advertising | block | amazon-adsystem.com aax.amazon-adsystem.com s.amazon-adsystem.com | ad-id ad-privacy x-wl-uid |
pinterest | Pinterest Tag | Pinterest | advertising | block | ct.pinterest.com pintrk s.pinimg.com | _pinterest_sess _pinterest_ct_ua csrftoken |
snapchat | Snapchat Pixel | Snap | advertising | block | tr.snapchat.com sc-static.net | _scid _scid_r _sctr |
reddit_ads | Reddit Pixel | Reddit | advertising | block | alb.reddit.com rp.reddit.com events.reddit.com | reddaid |
adobe_audience | Adobe Audience Manager | Adobe | advertising | block | demdex.net omtrdc.net 2o7.net | demdex dpm s_ecid |
pubmatic | PubMatic | PubMatic | advertising | block | image6.pubmatic.com image8.pubmatic.com ads.pubmatic.com | KRTBCOOKIE_ PugT |
magnite | Magnite (Rubicon) | Magnite | advertising | block | fastlane.rubiconproject.com tap.rubiconproject.com eus.rubiconproject.com | rpx put_ |
appnexus | AppNexus / Xandr (Microsoft) | Microsoft | advertising | block | ib.adnxs.com secure.adnxs.com acdn.adnxs.com | uuid2 anj sess |
openx | OpenX | OpenX | advertising | block | u.openx.net d.openx.net i.openx.net | i pd |
twitter_x | X (Twitter) Pixel | X Corp. | social | block | static.ads-twitter.com t.co analytics.twitter.com ads-api.twitter.com | guest_id guest_id_ads guest_id_marketing personalization_id ct0 |
onetrust | OneTrust | OneTrust | consent | allow | cdn.cookielaw.org geolocation.onetrust.com privacyportal.onetrust.com | OptanonConsent OptanonAlertBoxClosed eupubconsent-v2 |
cookiebot | Cookiebot | Usercentrics | consent | allow | consent.cookiebot.com consentcdn.cookiebot.com | CookieConsent |
didomi | Didomi | Didomi | consent | allow | sdk.privacy-center.org consent.privacy-center.org | euconsent-v2 didomi_token |
sentry | Sentry | Sentry | utilities | allow | sentry.io o0.ingest.sentry.io browser.sentry-cdn.com | |
cloudflare_insights | Cloudflare Web Analytics | Cloudflare | analytics | allow | static.cloudflareinsights.com cloudflareinsights.com | |
intercom | Intercom | Intercom | utilities | strip | js.intercomcdn.com api.intercom.io widget.intercom.io | intercom-id- intercom-session- intercom-device-id- | user_id email name
hubspot | HubSpot | HubSpot | analytics | block | js.hs-scripts.com js.hsforms.net track.hubspot.com api.hubapi.com | hubspotutk __hstc __hssrc __hssc __hsfp |
optimizely | Optimizely | Optimizely | utilities | strip | cdn.optimizely.com logx.optimizely.com | optimizelyBuckets optimizelyEndUserId optimizelySegments |
zendesk | Zendesk | Zendesk | utilities | allow | ekr.zdassets.com static.zdassets.com | ZD- __zlcid __zl |
"""

# Template overrides, as "action: trackers".
TEMPLATE_ROWS = {
    "ultra-streng": {
        "block": "meta_pixel google_ads tiktok linkedin_ads microsoft_ads criteo taboola outbrain tradedesk "
        "amazon_ads pinterest snapchat reddit_ads adobe_audience pubmatic magnite appnexus openx twitter_x "
        "hotjar fullstory microsoft_clarity mixpanel amplitude segment chartbeat comscore yandex_metrika heap pendo",
        "strip": "ga4 ga_signals",
        "allow": "onetrust cookiebot didomi",
    },
    "basis-analytics": {
        "block": "meta_pixel google_ads tiktok fullstory",
        "strip": "ga4 ga_signals hotjar microsoft_clarity",
    },
    "marketing-light": {
        "block": "hotjar fullstory tiktok yandex_metrika",
        "strip": "ga4 meta_pixel google_ads",
    },
    "custom": {},
}
DEFAULT_TEMPLATE = "ultra-streng"
ALLOW_ALL_TEMPLATE = "alles-allow"

# Categories as (key, label, colour, default action).
CATEGORIES = [
    ("advertising", "Advertising", "#ef4444", "block"),
    ("analytics", "Site Analytics", "#f5c400", "strip"),
    ("social", "Social Media", "#60a5fa", "block"),
    ("consent", "Consent Management", "#00ff9d", "allow"),
    ("utilities", "Utilities", "#a78bfa", "allow"),
    ("hosting", "Hosting/CDN", "#8a8e98", "allow"),
]

# Request patterns (regular expressions, one per word).
INTERCEPT_PATTERNS = r"""
google-analytics\.com\/g\/collect analytics\.google\.com\/g\/collect region\d*\.google-analytics\.com
googletagmanager\.com\/gtm\.js googletagmanager\.com\/gtag\/js connect\.facebook\.net
facebook\.com\/tr graph\.facebook\.com googleads\.g\.doubleclick\.net pagead2\.googlesyndication\.com
www\.googleadservices\.com adservice\.google\. analytics\.tiktok\.com ads\.tiktok\.com
snap\.licdn\.com px\.ads\.linkedin\.com dc\.ads\.linkedin\.com bat\.bing\.com universal\.bing\.com clarity\.ms
static\.hotjar\.com vars\.hotjar\.com vc\.hotjar\.io ask\.hotjar\.io rs\.fullstory\.com edge\.fullstory\.com
api\.segment\.io cdn\.segment\.com api\.amplitude\.com api2\.amplitude\.com api\.mixpanel\.com
static\.criteo\.net dis\.criteo\.com static\.ads-twitter\.com analytics\.twitter\.com ct\.pinterest\.com
tr\.snapchat\.com sc-static\.net alb\.reddit\.com events\.reddit\.com amplify\.outbrain\.com trc\.taboola\.com
mc\.yandex\.ru mc\.yandex\.com heapanalytics\.com track\.hubspot\.com pixel\.quantserve\.com
beacon\.scorecardresearch\.com amazon-adsystem\.com secure\.adnxs\.com ib\.adnxs\.com
piwik\.pro \.piwik\.pro piwikpro\.com ppms\.php ppms\.js matomo\.php piwik\.php matomo\.cloud \.matomo\.cloud
\.sc\.omtrdc\.net \/b\/ss\/ data\.adobedc\.net \.adobedc\.net tt\.omtrdc\.net demdex\.net everesttech\.net
collector\.[^/]*snplow snowplowanalytics sp\.pixel tags\.tiqcdn\.com collect\.tealiumiq\.com \.tealiumiq\.com
contentsquare\.net contentsquare\.com leadinfo\.net snitcher\.com
""".split()

# Script sources that are always blocked (regular expressions).
SCRIPT_PATTERNS = r"""
googletagmanager\.com\/gtm\.js connect\.facebook\.net\/.*\/fbevents\.js static\.hotjar\.com\/c\/hotjar
bat\.bing\.com\/bat\.js analytics\.tiktok\.com\/i18n\/pixel tr\.snapchat\.com\/p\.js ct\.pinterest\.com\/v3
static\.ads-twitter\.com\/uwt\.js
""".split()

# Cookie-name prefixes that are blocked.
COOKIE_PREFIXES = """
_ga _gid _gat _dc_gtm_ __utma __utmb __utmc __utmz _fbp _fbc fr datr sb _ttp _tt_enable_cookie _hjid _hjSession
_hjTLDTest mp_ ajs_ li_sugr bcookie li_gc MUID _uetsid _uetvid IDE ANID NID __gads __gpi cto_bundle obuid TDID
_scid _pinterest_sess reddaid
""".split()

# Hosts (substrings) that count as a direct leak in a page audit, in match order.
AUDIT_HOSTS = """
google-analytics.com analytics.google.com googletagmanager.com g/collect stats.g.doubleclick.net piwik.pro
piwikpro.com matomo.cloud sc.omtrdc.net adobedc.net tt.omtrdc.net demdex.net everesttech.net tealiumiq.com
tiqcdn.com snowplowanalytics snplow mixpanel.com amplitude.com segment.io segment.com hotjar.com hotjar.io
clarity.ms fullstory.com mc.yandex.ru mc.yandex.com heapanalytics.com contentsquare.net scorecardresearch.com
quantserve.com chartbeat.com facebook.com/tr connect.facebook.net doubleclick.net ads.tiktok.com
analytics.tiktok.com bat.bing.com px.ads.linkedin.com snap.licdn.com criteo.net criteo.com taboola.com
outbrain.com adnxs.com pubmatic.com ct.pinterest.com tr.snapchat.com reddit.com
""".split()

# Vendor routes, tried in order (case-insensitive); anything else is "generic".
ROUTE_PATTERNS = [
    ("piwik", r"(piwik\.pro|piwikpro\.com|ppms\.php|matomo\.php|piwik\.php|matomo\.cloud)"),
    ("adobe", r"(\.sc\.omtrdc\.net|\/b\/ss\/|adobedc\.net|tt\.omtrdc\.net)"),
]
# The rule whose strip fields a vendor route uses.
ROUTE_TRACKER = {"piwik": "piwik_pro", "adobe": "adobe_analytics"}


@dataclass(frozen=True)
class Rule:
    key: str
    name: str
    vendor: str
    category: str
    default_action: str
    patterns: tuple[str, ...]
    cookies: tuple[str, ...] = ()
    strip_fields: tuple[str, ...] = ()


def load_rules(text: str = TRACKER_ROWS) -> list[Rule]:
    """Parse a rule table; the line order is the match order."""
    rules = []
    for line in filter(None, (ln.strip() for ln in text.splitlines())):
        cells = [c.strip() for c in line.split("|")]
        rules.append(Rule(*cells[:5], *(tuple(c.split()) for c in cells[5:8])))
    return rules


def template_overrides(template: str) -> dict[str, str]:
    """Overrides of one template; an unknown name falls back to the default template."""
    by_action = TEMPLATE_ROWS.get(template, TEMPLATE_ROWS[DEFAULT_TEMPLATE])
    return {tracker: action for action, names in by_action.items() for tracker in names.split()}


def rules_df(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The catalogue: one row per rule."""
    rows = [
        (i, r.key, r.name, r.vendor, r.category, r.default_action, list(r.patterns), list(r.cookies), list(r.strip_fields))
        for i, r in enumerate(rules or load_rules())
    ]
    return spark.createDataFrame(
        rows,
        "rule_ord INT, tracker STRING, name STRING, vendor STRING, category STRING, default_action STRING, "
        "patterns ARRAY<STRING>, cookies ARRAY<STRING>, strip_fields ARRAY<STRING>",
    )


def templates_df(spark: SparkSession) -> DataFrame:
    """Overrides in long form ``(template, tracker, action)``, with the allow-all template."""
    rows = [(t, k, a) for t in TEMPLATE_ROWS for k, a in template_overrides(t).items()]
    rows += [(ALLOW_ALL_TEMPLATE, r.key, "allow") for r in load_rules()]
    return spark.createDataFrame(rows, "template STRING, tracker STRING, action STRING")


def categories_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "category STRING, label STRING, color STRING, default_action STRING")
