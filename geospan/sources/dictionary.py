"""Attribute dictionary (S04): column names per header language and dtype tags.

The occurrence export names each column three ways (technical, Finnish,
English). The dtype tag decides how a column is typed: ``bool`` -> boolean,
``int`` -> double with nulls, ``object``/``category`` (and any column not in
the dictionary) -> text.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import SparkSession

LANGUAGE_ROW = {"tech": 0, "fi": 1, "en": 2}

# The attribute dictionary (tech, fi, en, dtype), tab separated,
# in its original order.
DICTIONARY_TSV = """\
tech	fi	en	dtype
occurrenceID	Havainnon tunniste	Occurrence ID	object
eventID	Keruutapahtuman tunniste	Event ID	object
parentEventID	Näytteen tunniste / Havaintoerä	Specimen ID / Parent Event ID	object
verbatimIdentification	Ilmoitettu nimi	Verbatim Identification	object
recordedBy	Havainnoijat / Kerääjät	Recorded By / Collector	object
identifiedBy	Määrittäjä	Identified By	object
taxonConceptID	Taksonikäsitteen tunniste	Taxon Concept ID	object
scientificName	Tieteellinen nimi	Scientific Name	object
scientificNameAuthorship	Auktori	Scientific Name Authorship	object
taxonRank	Taksonominen taso	Taxon Rank	category
kingdom	Eliökunta	Kingdom	category
class	Luokka	Class	object
order	Lahko	Order	object
family	Heimo	Family	object
informalTaxonGroup	Eliöryhmä	Informal Taxon Group	category
vernacularName	Yleiskielinen nimi (suomi)	Vernacular Name (Finnish)	object
vernacularNameSwedish	Yleiskielinen nimi (ruotsi)	Vernacular Name (Swedish)	object
redListStatusFinland	Uhanalaisuus Suomessa	Red List Status (Finland)	object
lajiturvaStatus	Lajiturva -luokittelu	Lajiturva Status	category
regulatoryStatuses	Hallinnollinen asema	Regulatory Statuses	category
taxonPreferredHabitat	Lajin elinympäristö	Taxon Preferred Habitat	object
habitat	Havainnon habitaatti	Occurrence Habitat	object
isSensitiveTaxon	Sensitiivinen laji	Is Sensitive Taxon	bool
dataGeneralizations	Karkeistustaso	Data Generalizations	category
informationWithheld	Karkeistuksen syyt	Information Withheld	category
datasetCurationLevel	Aineiston laatu	Dataset Curation Level	category
identificationVerificationStatus	Havainnon luotettavuus	Identification Verification Status	category
qualityControl	Laadunvalvontatagit	Quality Control Tags	object
datasetID	Aineiston/Kokoelman tunniste	Dataset ID	object
datasetName	Aineisto/Kokoelma	Dataset Name	object
source	Lähdejärjestelmän tunniste	Source ID	object
sourceName	Lähdejärjestelmä	Source Name	object
originatingSource	Alkuperäinen tietolähde	Originating Source	object
eventDate	Havaintoaika	Event Date	object
countryCode	Maa	Country	object
biogeographicalProvince	Eliömaakunta	Biogeographical Province	category
municipality	Kunta	Municipality	object
verbatimLocality	Ilmoitetut paikannimet	Verbatim Locality	object
locationID	Seurantapaikan tunniste	Site ID	object
locationType	Seurantapaikan tyyppi	Site Type	category
locationStatus	Seurantapaikan tila	Site Status	category
basisOfRecord	Havainnointitapa	Basis of Record	category
lifeStage	Elinvaihe	Life Stage	category
sex	Sukupuoli	Sex	category
femaleIndividualCount	Naaraiden yksilömäärä	Female Individual Count	int
maleIndividualCount	Koiraiden yksilömäärä	Male Individual Count	int
organismQuantity	Määrä	Abundance	object
organismQuantityType	Määrän yksikkö	Abundance Unit	object
individualCount	Tulkittu yksilömäärä (min)	Interpreted Individual Count (min)	int
pairCount	Parimäärä	Pair Count	int
isMigrating	Muuttaja	Migration Status	bool
isBreedingSite	Lisääntymispaikka	Breeding Site	bool
invasiveTaxonManagementAction	Vieraslajin torjunta	Invasive Taxon Management Action	category
atlasCode	Pesimävarmuusindeksi	Breeding Bird Atlas Code	category
atlasClass	Pesimävarmuusluokka	Breeding Bird Atlas Class	category
dynamicProperties	Lisämuuttujat	Additional Attributes	object
georeferenceSources	Koordinaattien lähde	Coordinate Source	category
isStateLand	Valtion maalla	State Land	bool
coordinateAccuracy	Koordinaattien tarkkuus (m)	Coordinate Accuracy (m)	int
footprintWKT	WGS84 geometria	Footprint WKT	object
gridCellYKJ	YKJ kymppiruutu	YKJ 10km Grid Cell	object
occurrenceRemarks	Lisätiedot havainnosta	Occurrence Remarks	object
eventRemarks	Lisätiedot keruutapahtumasta	Event Remarks	object
additionalIDs	Lisätunnisteet	Additional IDs	object
availableDate	Vastaanotettu Lajitietokeskuksessa	Date Available in FinBIF	object
license	Lisenssi	License	category
qualityIssues	Virheet	Quality Issues	object
otherCatalogNumbers	Lisätunnisteet	Additional IDs	object
county	Kunta	County	object
"""


def _rows(text: str) -> list[dict]:
    return list(csv.DictReader(io.StringIO(text), delimiter="\t"))


def column_types(language: str, text: str = DICTIONARY_TSV) -> dict[str, str]:
    """``{column name in language: dtype}``; later duplicates win."""
    if language not in LANGUAGE_ROW:
        raise ValueError(f"lang must be one of {sorted(LANGUAGE_ROW)}, got {language!r}")
    return {r[language]: r["dtype"] for r in _rows(text)}


def read_dictionary(spark: SparkSession, path: str, language: str) -> dict[str, str]:
    """S04 from a file: a small tab-separated table read by Spark, collected once."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    return {r[language]: r["dtype"] for r in df.select(language, "dtype").collect()}


def dtype_of(types: dict[str, str], column: str) -> str:
    return types.get(column, "object")
