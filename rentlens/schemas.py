"""Record layouts (Spark DDL), vocabularies and service limits.

Readers always pass these layouts to Spark; nothing is ever inferred.
"""

# Listing, one JSON object per listing, camelCase keys.
LISTING = """
id BIGINT, bedrooms INT, bathrooms INT, numberOfImages INT, numberOfFloorplans INT,
numberOfVirtualTours INT, summary STRING, displayAddress STRING, countryCode STRING,
location STRUCT<latitude: DOUBLE, longitude: DOUBLE>,
propertyImages STRUCT<images: ARRAY<STRUCT<url: STRING, caption: STRING, srcUrl: STRING>>,
  mainImageSrc: STRING, mainMapImageSrc: STRING>,
propertySubType STRING,
listingUpdate STRUCT<listingUpdateReason: STRING, listingUpdateDate: TIMESTAMP>,
price STRUCT<amount: INT, frequency: STRING, currencyCode: STRING,
  displayPrices: ARRAY<STRUCT<displayPrice: STRING, displayPriceQualifier: STRING>>>,
premiumListing BOOLEAN, featuredProperty BOOLEAN,
customer STRUCT<branchId: INT, brandPlusLogoUri: STRING, contactTelephone: STRING,
  branchDisplayName: STRING, branchName: STRING, brandTradingName: STRING,
  branchLandingPageUrl: STRING, development: BOOLEAN, showReducedProperties: BOOLEAN,
  commercial: BOOLEAN, showOnMap: BOOLEAN, enhancedListing: BOOLEAN,
  developmentContent: STRUCT<headline: STRING, features: STRING>, buildToRent: BOOLEAN,
  buildToRentBenefits: ARRAY<STRUCT<id: INT, label: STRING, icon: STRING, positionOnPage: INT>>,
  brandPlusLogoUrl: STRING>,
distance DOUBLE, transactionType STRING,
productLabel STRUCT<productLabelText: STRING, spotlightLabel: BOOLEAN>,
commercial BOOLEAN, development BOOLEAN, residential BOOLEAN, students BOOLEAN, auction BOOLEAN,
feesApply BOOLEAN, feesApplyText STRING, displaySize STRING, showOnMap BOOLEAN,
propertyUrl STRING, contactUrl STRING, staticMapUrl STRING, channel STRING,
firstVisibleDate TIMESTAMP, keywords ARRAY<STRING>, keywordMatchType STRING,
saved BOOLEAN, hidden BOOLEAN, onlineViewingsAvailable BOOLEAN,
lozengeModel STRUCT<matchingLozenges: ARRAY<STRUCT<type: STRING, priority: INT>>>,
hasBrandPlus BOOLEAN, displayStatus STRING, enquiredTimestamp STRING,
enquiryAddedTimestamp STRING, enquiryCalledTimestamp STRING, heading STRING, isRecent BOOLEAN,
enhancedListing BOOLEAN, addedOrReduced STRING, formattedBranchName STRING,
formattedDistance STRING, propertyTypeFullDescription STRING
"""

# Listing fields that must be present and not null.
LISTING_REQUIRED = (
    "id", "bedrooms", "summary", "location", "location.latitude", "location.longitude",
    "commercial", "development", "residential", "students", "auction", "channel", "heading",
)

# Fields that a nested record must have where it is there itself: name and when it is missing.
LISTING_NESTED_REQUIRED = {
    "price.amount": "price is not null and price.amount is null",
    "price.frequency": "price is not null and price.frequency is null",
    "price.displayPrices": "exists(price.displayPrices, p -> p.displayPrice is null or p.displayPriceQualifier is null)",
    "customer.development": "customer is not null and customer.development is null",
    "customer.commercial": "customer is not null and customer.commercial is null",
    "customer.buildToRentBenefits": "customer is not null and (customer.buildToRentBenefits is null or "
    "exists(customer.buildToRentBenefits, b -> b.id is null or b.label is null or b.icon is null or b.positionOnPage is null))",
    "propertyImages.images": "propertyImages is not null and (propertyImages.images is null or "
    "exists(propertyImages.images, i -> i.url is null or i.srcUrl is null))",
    "propertyImages.mainImageSrc": "propertyImages is not null and propertyImages.mainImageSrc is null",
    "propertyImages.mainMapImageSrc": "propertyImages is not null and propertyImages.mainMapImageSrc is null",
    "productLabel.spotlightLabel": "productLabel is not null and productLabel.spotlightLabel is null",
    "lozengeModel.matchingLozenges": "lozengeModel is not null and (lozengeModel.matchingLozenges is null or "
    "exists(lozengeModel.matchingLozenges, t -> t.type is null or t.priority is null))",
}

LOCATION_MATCHES = """
matches ARRAY<STRUCT<id: STRING, type: STRING, displayName: STRING, highlighting: STRING,
  highlights: ARRAY<STRUCT<text: STRING, highlighted: BOOLEAN>>>>
"""

_STOP_POINT = """STRUCT<name: STRING, icsCode: STRING, topMostParentId: STRING,
  modes: ARRAY<STRING>, stopLetter: STRING, commonName: STRING>"""

JOURNEY = f"""STRUCT<startDateTime: TIMESTAMP, duration: INT, arrivalDateTime: TIMESTAMP,
  alternativeRoute: BOOLEAN, legs: ARRAY<STRUCT<duration: INT,
    instruction: STRUCT<summary: STRING, detailed: STRING, steps: ARRAY<STRUCT<
      description: STRING, turnDirection: STRING, streetName: STRING, distance: INT,
      cumulativeDistance: INT, skyDirection: INT, skyDirectionDescription: STRING,
      cumulativeTravelTime: INT, latitude: DOUBLE, longitude: DOUBLE,
      pathAttribute: STRUCT<`$type`: STRING>, descriptionHeading: STRING, trackType: STRING,
      travelTime: INT>>>,
    obstacles: ARRAY<STRUCT<type: STRING, incline: STRING, stopId: INT, position: STRING>>,
    departureTime: TIMESTAMP, arrivalTime: TIMESTAMP,
    departurePoint: {_STOP_POINT}, arrivalPoint: {_STOP_POINT},
    path: STRUCT<lineString: STRING, stopPoints: ARRAY<STRING>, elevation: ARRAY<STRING>>,
    routeOptions: ARRAY<STRUCT<name: STRING, directions: ARRAY<STRING>, lineIdentifier: STRING>>,
    mode: STRUCT<id: STRING, name: STRING, type: STRING, routeType: STRING, status: STRING,
      motType: STRING, network: STRING>,
    disruptions: ARRAY<STRING>, plannedWorks: ARRAY<STRING>, distance: DOUBLE,
    isDisrupted: BOOLEAN, hasFixedLocations: BOOLEAN, scheduledDepartureTime: TIMESTAMP,
    scheduledArrivalTime: TIMESTAMP, interChangeDuration: STRING, interChangePosition: STRING>>,
  fare: STRUCT<totalCost: INT, fares: ARRAY<STRING>, caveats: ARRAY<STRING>>>"""

JOURNEY_RESULTS = f"""
journeys ARRAY<{JOURNEY}>,
lines ARRAY<STRUCT<id: STRING, name: STRING, modeName: STRING, disruptions: ARRAY<STRING>,
  created: TIMESTAMP, modified: TIMESTAMP, lineStatuses: ARRAY<STRUCT<id: INT,
    statusSeverity: INT, statusSeverityDescription: STRING, created: TIMESTAMP>>,
  routeSections: ARRAY<STRING>, serviceTypes: ARRAY<STRUCT<name: STRING, uri: STRING>>>>,
stopMessages ARRAY<STRING>, recommendedMaxAgeMinutes INT,
searchCriteria STRUCT<dateTime: TIMESTAMP, dateTimeType: STRING>,
journeyVector STRUCT<`from`: STRING, `to`: STRING, via: STRING, uri: STRING>
"""

JOURNEY_RESULTS_REQUIRED = (
    "journeys", "lines", "stopMessages", "recommendedMaxAgeMinutes", "searchCriteria",
    "journeyVector",
)

JOURNEY_RESULTS_NESTED_REQUIRED = {
    "a journey's times, duration, legs or fare": "exists(journeys, j -> j.startDateTime is null or j.arrivalDateTime is null "
    "or j.duration is null or j.alternativeRoute is null or j.legs is null or j.fare.totalCost is null)",
    "a leg's times, duration or mode": "exists(journeys, j -> exists(j.legs, l -> l.departureTime is null or l.arrivalTime is null "
    "or l.duration is null or l.mode.id is null or l.instruction is null or l.isDisrupted is null))",
    "a leg's stop names": "exists(journeys, j -> exists(j.legs, l -> l.departurePoint.commonName is null or l.arrivalPoint.commonName is null))",
}

STATION = """
_id STRING, _type STRING, name STRING, contactDetails STRUCT<address: STRING, phone: STRING>,
servingLines STRUCT<servingLine: ARRAY<STRING>>, zones STRUCT<zone: ARRAY<STRING>>,
facilities STRUCT<facility: ARRAY<STRUCT<_name: STRING, _VALUE: STRING>>>,
entrances STRUCT<entrance: ARRAY<STRUCT<name: STRING,
  entranceToBookingHall: STRUCT<entranceToBookingHallDirection: STRING,
    entranceToBookingHallSteps: STRING>,
  entranceToBookingHallDirection: STRING, entranceToBookingHallSteps: STRING,
  bookingHallToPlatform: ARRAY<STRUCT<pointName: STRING, pathDescription: STRING,
    path: ARRAY<STRUCT<heading: STRING, pathDescription: STRING>>>>,
  platformToTrain: ARRAY<STRUCT<trainName: STRING, platformToTrainSteps: STRING>>>>>,
openingHours STRUCT<openingHour: ARRAY<STRUCT<entrance: STRING, timeIntervals: ARRAY<STRUCT<
  _type: STRING, timeInterval: ARRAY<STRUCT<`from`: STRING, `to`: STRING>>>>>>>,
Placemark STRUCT<name: STRING, description: STRING, Point: STRUCT<coordinates: STRING>,
  styleUrl: STRING>
"""

STATION_REQUIRED = ("_id", "name", "contactDetails", "contactDetails.address", "contactDetails.phone")

# Head of the station feed: the fields of its Header element.
STATION_FEED_HEADER = """
_canonical STRING, Identifier STRING, DisplayTitle STRING, Version STRING,
PublishDateTime STRING, Author STRING, Owner STRING, RefreshRate INT, Max_Latency INT,
TimeToError INT, Schedule STRING
"""

# Transport modes a journey leg may use.
MODE_IDS = (
    "bus", "cable-car", "coach", "cycle", "cycle-hire", "dlr", "elizabeth-line",
    "interchange-keep-sitting", "interchange-secure", "national-rail", "overground",
    "replacement-bus", "river-bus", "river-tour", "taxi", "tram", "tube", "walking",
)

# Postcode directory columns, and the local-authority range of the 33 London boroughs.
POSTCODE_COLUMNS = ("PCD", "LAT", "LONG", "DOTERM", "OSGRDIND", "USERTYPE", "OSLAUA")
LONDON_AREA_CODES = (9000001, 9000033)

# Search vocabularies.
MUST_HAVE = ("garden", "parking")
DONT_SHOW = ("houseShare", "retirement", "student")
FURNISH_TYPES = ("furnished", "partFurnished", "unfurnished")
PROPERTY_TYPES = (
    "flat", "land", "park-home", "private-halls", "detached", "semi-detached", "terraced",
)
CHANNELS = ("RENT", "BUY")

# Service limits.
LIST_CAP = 1000
MAP_CAP = 499
IDS_PER_REQUEST = 25
VIEW_BATCH = 3
LOOKUP_LIMIT = 20

# Square metres per square foot, and the text that marks a size in square feet.
SQM_PER_SQFT = 0.092903
SQFT_SUFFIX = " sq. ft."

LET_AGREED = "LET_AGREED"
STATION_PREFIX = "STATION^"
# Route links: base address, and the query keys around origin and destination.
ROUTE_LINKS = {
    "google": ("https://www.google.com/maps/dir/?api=1&origin=", "&destination=", "&travelmode=transit"),
    "apple": ("https://maps.apple.com/?saddr=", "&daddr=", "&dirflg=r"),
}
