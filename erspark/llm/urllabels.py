"""A small labelled table of urls: hosts of kinds that crawlers leave out, and ordinary ones.

Made by hand from kinds of sites that public block lists name (link farms, unlicensed pharmacies, betting, advertising
and tracking, adult sites, malware and phishing) and from everyday ones. Hosts are invented, and no host that the engine
is tried on is among them; ``HELD_OUT`` are hosts that the model is never fitted on.
"""

#: Unwanted hosts by kind; 1 in the table.
UNWANTED = {
    "link farms": "link-spam seo-spam spamhub spam-directory linkfarm farm-of-links backlink-farm buy-backlinks spammy-articles article-farm content-farm clickfarm",
    "pharmacies": "discount-pills pillstore pills4less no-rx-meds cheap-meds cheapviagra cheap-watches rx-discount cheap-loans cheapest-tabs buy-cheap-rx pill-shop",
    "betting": "casino-royal online-casino casinoslots lucky-casino win-big winjackpot slots-win free-slots freespins freecash bets24 sportbets bet-now betwin poker-bets free-money",
    "trackers": "adserver ads-network adsrv popup-ads banner-ads trackpixel click-track tracking-pixel adtracker track-clicks ads4u trk-redirect",
    "adult": "adult-videos adultchat adult-dating xxx-tube xxxlive hot-cams sex-cams nude-pics x-rated adultfriend",
    "malware": "free-download-crack keygen-free warez-zone cracked-apps login-verify secure-login-update account-verify prize-winner you-won virus-alert",
}
#: Ordinary hosts; 0 in the table.
ORDINARY = (
    "citylibrary stationery weather-north the-herald theatre-guild mountain-hikes riverside-school motherboard-forum gardening-notes railway-museum "
    "nationalarchive thinktank education-portal thursday-market northern-lights open-source-handbook thermal-energy motion-studio handmade-pottery "
    "photography-club thesis-archive mathematics-help translation-bureau orchard-farm healthcare-news breadbaking history-of-printing townhall "
    "lighthouse-inn chesterton-society bookshop wikidictionary sailing-school anthology birdwatching veterinary-care stonemasons conference-room "
    "rathaus-stadt universite-lettres biblioteca-nacional mairie-nantes hochschule-nord periodico-diario kirchengemeinde musee-de-la-mer "
    "thatched-roofs another-day fatherhood interthread ornithology tonight-tv landing-stage hinterland enthusiast reading-list "
    "software-testing distributed-systems astronomy-today botanical-garden chess-problems folk-songs recipes-at-home cycling-routes"
)
#: Kinds of hosts kept apart to measure the model: (label, hosts).
HELD_OUT = (
    (1, "spam-kingdom cheappills-online megacasino free-bets-today ads-tracker adult-tube win-prizes spamfarms pills-cheap track-ad casino-spins betting-free xxx-adult"),
    (0, "the-nation brotherhood northstation weathering heather-hills thunder-theatre library-of-things ostrich-farming translations thorn-garden letterpress rothenburg handling"),
)
#: Paths that urls are made with, for either label: paths tell little by themselves.
PATHS = ("/", "/en/12", "/de/7/", "/fr/853.html", "/es/76?page=2&ref=x", "/article/1#top", "/en/25?utm_source=feed")
#: Paths that speak for a label.
OWN_PATHS = {1: ("/buy-now/", "/bonus/claim", "/click?id=1", "/out/redirect"), 0: ("/about", "/archive/2019", "/contact.html", "/news/today")}
PREFIXES, ENDS = ("", "www.", "m.", "blog."), ("org", "com", "net")


def table(hosts: dict[int, list[str]]) -> list[tuple[str, str, int]]:
    """``(host, path, label)``: each host under several prefixes, ends and paths, which say nothing of the label."""
    out = []
    for label, names in hosts.items():
        for k, name in enumerate(names):
            for i, path in enumerate((*PATHS, *OWN_PATHS[label])):
                out.append((f"{PREFIXES[(k + i) % 4]}{name}.example.{ENDS[(k // 4 + i) % 3]}", path.split("?")[0].split("#")[0], label))
    return out


def training_table() -> list[tuple[str, str, int]]:
    return table({1: [h for names in UNWANTED.values() for h in names.split()], 0: ORDINARY.split()})


def held_out_table() -> list[tuple[str, str, int]]:
    return table({label: names.split() for label, names in HELD_OUT})
