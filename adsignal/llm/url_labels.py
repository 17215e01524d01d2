"""The small labelled table that the URL classifier is trained on: unwanted and wanted addresses.

The addresses are written for this purpose, by topic, under names that are reserved for examples.  Subjects and
spellings vary within a topic, since the classifier learns parts of words.  They follow no table's hosts or paths.
"""

BLOCK = """
http://grand-casino-lounge.example/slots/free-spins http://casinoroyale77.example/bonus http://m.live-casinos.example/roulette https://play.megaslots.example/jackpot/win
http://betking-odds.example/football/tips https://blog.sportsbetting-hub.example/bets http://bet365day.example/signup http://freebet-offers.example/index.html http://blog.poker-nights.example/holdem
http://m.lottery-winner.example/contact https://you-won.example/congratulations/iphone http://winbig-sweepstakes.example/enter http://luckyprize.example/spin-wheel
http://cheapmeds-rx.example/viagra/buy-online http://blog.pillstore.example/index.html https://discount-pharma.example/no-prescription http://m.pills4less.example/start http://dietpills-now.example/weight-loss
http://replica-watches.example/rolex http://www.cheap-handbags.example/outlet/louis http://fake-designer.example/shop http://m.cheaprolex.example/start
http://payday-loan-fast.example/apply-now https://instant-loans.example/bad-credit http://debt-relief.example/quick-cash http://cheap-mortgage.example/refinance
http://www.xxx-videos.example/index.html http://m.adult-cams.example/start https://hotgirls-dating.example/nude http://pornhive.example/tube http://blog.escort-adults.example/start http://sexchat.example/join
http://blog.spamhaven.example/index.html http://www.linkfarm-seo.example/page http://www.buy-backlinks.example/pagerank https://article-spinner.example/auto-blog http://contentfarm9.example/top10 http://spam-directory.example/submit http://m.farmlinks.example/archive
http://adserver-click.example/banner?id=9 https://tracking-pixel.example/px.gif http://popunder-ads.example/serve http://adtracker.example/redirect?u=1 http://click-trackers.example/aff https://m.adsnetwork.example/overview http://blog.doubleads-tracker.example/contact
http://free-download-crack.example/keygen http://warez-central.example/serial http://m.torrentz-movies.example/archive http://www.cracked-apps.example/apk-mod http://freemoviez.example/stream
http://make-money-fast.example/work-from-home https://crypto-doubler.example/invest http://forex-signals.example/guaranteed-profit http://bitcoin-giveaway.example/double http://blog.getrichquick.example/archive
http://secure-login-verify.example/account/update http://paypa1-support.example/confirm https://bank-alerts.example/password/reset http://free-giftcards.example/generator http://win-free-phone.example/survey
""".split()

ALLOW = """
https://www.university-lib.example/catalogue/search http://physics.college.example/courses/mechanics https://school-district.example/calendar http://research.institute.example/papers/2019/climate https://www.kindergarten.example/about
https://news.dailyherald.example/world/election http://www.morning-gazette.example/local/council https://journal.example/opinion/letters http://thechronicle.example/archive/1998 https://radio-station.example/programmes/morning
https://museum-of-art.example/exhibitions/spring http://www.natural-history.example/fossils https://theatre-royal.example/tickets/hamlet http://orchestra.example/concerts https://opera.example/season https://gallery.example/artists
http://recipes.homecook.example/soups/lentil https://www.bakingbread.example/sourdough http://kitchen-garden.example/herbs https://vegetarian.example/dinners http://wine-and-cheese.example/regions
https://hospital.example/departments/cardiology http://www.nursing.example/training https://health-service.example/vaccination http://dentist.example/appointments https://medicine.example/guidelines
https://docs.library-project.example/api/reference http://wiki.compiler.example/manual/install https://developer.example/tutorials/python http://m.linux-users.example/overview https://git.example/issues/312
http://www.townhall.example/services/waste https://ministry.example/statistics/population http://parliament.example/debates/2021 https://court.example/judgments http://tax-office.example/forms
https://www.railways.example/timetable http://airport.example/arrivals https://hiking-trails.example/alps http://blog.travelnotes.example/contact https://hostels.example/lisbon http://maps.example/districts
https://www.footballclub.example/fixtures http://m.tennis.example/results https://chess-society.example/openings http://swimming.example/lessons https://m.athletics.example/start http://cycling.example/routes
http://weatherstation.example/forecast/north https://astronomy.example/nebula/orion http://m.geology.example/quartz https://ornithology.example/birds/heron http://botany.example/trees/oak https://mathematics.example/theorems
https://bookshop.example/fiction/novels http://www.poetry.example/sonnets https://publisher.example/authors http://dictionary.example/words/harbour https://translation.example/grammar http://history.example/medieval/monasteries
https://blog.architect.example/about http://www.carpentry.example/joints https://pottery.example/glazes http://knitting.example/patterns/scarf https://photography.example/lenses http://gardeners.example/roses
https://www.charity.example/donate http://church.example/services/sunday https://community-centre.example/classes http://blog.choir.example/contact https://veterans.example/memorial http://scouts.example/camps
https://engineering.example/steel/beams http://electronics.example/circuits/amplifier https://robotics.example/sensors http://chemistry.example/solvents https://statistics.example/regression http://economics.example/about
https://blog.translation.example/archive http://m.theology.example/contact https://blog.nutrition.example/about https://www.construction.example/archive http://m.weatherby.example/archive https://blog.thermal-baths.example/overview
""".split()
