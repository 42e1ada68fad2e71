"""Reference tables as DataFrames: small literals, or rules where a rule gives the rows.

All of them are constants (the largest has 175 rows) held as local relations: Spark knows their size and
broadcasts them, and what is derived from them, by its own threshold.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Generic name | brand names | dimension | canonical unit | maximum daily dose | maximum mg per kg and day.
MEDICATIONS = """
acetaminophen|tylenol,paracetamol,panadol,tempra,feverall|mass|mg|4000|75
ibuprofen|advil,motrin,nurofen,brufen|mass|mg|3200|40
naproxen|aleve,naprosyn,anaprox|mass|mg|1500|
aspirin|bayer,ecotrin,bufferin|mass|mg|4000|
celecoxib|celebrex|mass|mg|400|
tramadol|ultram,conzip,ryzolt|mass|mg|400|
morphine|ms contin,roxanol,kadian,avinza|mass|mg|120|
oxycodone|oxycontin,percocet,roxicodone,oxaydo|mass|mg|320|
hydrocodone|norco,vicodin,zohydro,hysingla|mass|mg|90|
codeine|tylenol with codeine,codeine phosphate|mass|mg|360|
amoxicillin|amoxil,trimox,moxatag|mass|mg|4000|90
azithromycin|zithromax,z-pak,zmax|mass|mg|500|
ciprofloxacin|cipro,cipro xr|mass|mg|1500|
doxycycline|vibramycin,doryx,monodox,oracea|mass|mg|200|
metronidazole|flagyl,metrogel,metrocream|mass|mg|4000|
clindamycin|cleocin,clindagel|mass|mg|4800|
trimethoprim-sulfamethoxazole|bactrim,septra,cotrimoxazole,tmp-smx|mass|mg|1600|
warfarin|coumadin,jantoven|mass|mg|15|
clopidogrel|plavix|mass|mg|75|
rivaroxaban|xarelto|mass|mg|20|
apixaban|eliquis|mass|mg|20|
digoxin|lanoxin,digitek|mass|mg|0.5|
amiodarone|cordarone,pacerone,nexterone|mass|mg|400|
lisinopril|prinivil,zestril,qbrelis|mass|mg|80|
losartan|cozaar|mass|mg|100|
valsartan|diovan|mass|mg|320|
metoprolol|lopressor,toprol-xl,toprol xl|mass|mg|400|
atenolol|tenormin|mass|mg|200|
amlodipine|norvasc|mass|mg|10|
diltiazem|cardizem,tiazac,cartia xt,dilacor xr|mass|mg|480|
hydrochlorothiazide|microzide,hctz,esidrix|mass|mg|50|
furosemide|lasix|mass|mg|600|
spironolactone|aldactone,carospir|mass|mg|400|
levothyroxine|synthroid,levoxyl,tirosint,unithroid,euthyrox|mass|mcg|300|
metformin|glucophage,fortamet,glumetza,riomet|mass|mg|2550|
glipizide|glucotrol,glucotrol xl|mass|mg|40|
insulin glargine|lantus,basaglar,toujeo,semglee|unit|units|100|
insulin|humulin,novolin,humulin n,humulin r,novolin n,novolin r|unit|units||
prednisone|deltasone,rayos,prednisone intensol|mass|mg|80|
methylprednisolone|medrol,solu-medrol,depo-medrol|mass|mg|1000|
allopurinol|zyloprim,aloprim|mass|mg|800|
colchicine|colcrys,mitigare,gloperba|mass|mg|1.8|
simvastatin|zocor|mass|mg|40|
atorvastatin|lipitor|mass|mg|80|
rosuvastatin|crestor,ezallor|mass|mg|40|
omeprazole|prilosec,zegerid|mass|mg|40|
pantoprazole|protonix|mass|mg|80|
metoclopramide|reglan,metozolv|mass|mg|40|
ondansetron|zofran,zuplenz|mass|mg|32|
fluoxetine|prozac,sarafem,selfemra|mass|mg|80|
sertraline|zoloft|mass|mg|200|
paroxetine|paxil,pexeva,brisdelle|mass|mg|60|
citalopram|celexa|mass|mg|40|
escitalopram|lexapro|mass|mg|20|
phenelzine|nardil|mass|mg|90|
tranylcypromine|parnate|mass|mg|60|
bupropion|wellbutrin,zyban,aplenzin,forfivo xl|mass|mg|450|
venlafaxine|effexor,effexor xr|mass|mg|225|
duloxetine|cymbalta,irenka|mass|mg|120|
amitriptyline|elavil|mass|mg|300|
quetiapine|seroquel,seroquel xr|mass|mg|800|
risperidone|risperdal,risperdal consta|mass|mg|16|
olanzapine|zyprexa,zyprexa zydis|mass|mg|20|
lithium|lithobid,eskalith,lithium carbonate|mass|mg|2400|
alprazolam|xanax,xanax xr,niravam|mass|mg|10|
diazepam|valium,diastat|mass|mg|40|
clonazepam|klonopin|mass|mg|20|
lorazepam|ativan|mass|mg|10|
zolpidem|ambien,ambien cr,edluar,intermezzo|mass|mg|10|
carbamazepine|tegretol,equetro,carbatrol|mass|mg|1600|
phenytoin|dilantin,phenytek|mass|mg|600|
valproic acid|depakote,depakene,depacon,valproate,divalproex|mass|mg|3000|
gabapentin|neurontin,gralise,horizant|mass|mg|3600|
pregabalin|lyrica,lyrica cr|mass|mg|600|
lamotrigine|lamictal,lamictal xr|mass|mg|700|
levetiracetam|keppra,keppra xr,spritam|mass|mg|3000|
topiramate|topamax,trokendi xr,qudexy xr|mass|mg|1600|
methotrexate|trexall,rheumatrex,otrexup,rasuvo|mass|mg|20|
sildenafil|viagra,revatio|mass|mg|100|
tadalafil|cialis,adcirca,alyq|mass|mg|20|
tamoxifen|nolvadex,soltamox|mass|mg|40|
finasteride|proscar,propecia|mass|mg|5|
"""

# Generic name | generic name | severity.
INTERACTIONS = """
phenelzine|fluoxetine|contraindicated
phenelzine|sertraline|contraindicated
phenelzine|paroxetine|contraindicated
phenelzine|citalopram|contraindicated
phenelzine|escitalopram|contraindicated
phenelzine|venlafaxine|contraindicated
phenelzine|duloxetine|contraindicated
phenelzine|tramadol|contraindicated
phenelzine|bupropion|contraindicated
tranylcypromine|fluoxetine|contraindicated
tranylcypromine|sertraline|contraindicated
tranylcypromine|paroxetine|contraindicated
tranylcypromine|venlafaxine|contraindicated
tranylcypromine|duloxetine|contraindicated
tranylcypromine|tramadol|contraindicated
tranylcypromine|bupropion|contraindicated
warfarin|ibuprofen|major
warfarin|naproxen|major
warfarin|aspirin|major
warfarin|ciprofloxacin|major
warfarin|amiodarone|major
warfarin|fluoxetine|major
warfarin|sertraline|major
warfarin|metronidazole|major
warfarin|carbamazepine|major
warfarin|phenytoin|major
warfarin|celecoxib|moderate
lisinopril|spironolactone|major
losartan|spironolactone|major
valsartan|spironolactone|major
lisinopril|losartan|major
lisinopril|valsartan|major
lisinopril|ibuprofen|major
lisinopril|naproxen|major
digoxin|amiodarone|major
digoxin|metoclopramide|moderate
lithium|ibuprofen|major
lithium|naproxen|major
lithium|hydrochlorothiazide|major
lithium|furosemide|major
lithium|lisinopril|major
simvastatin|amiodarone|major
simvastatin|diltiazem|major
colchicine|simvastatin|major
colchicine|atorvastatin|major
alprazolam|morphine|major
alprazolam|oxycodone|major
alprazolam|hydrocodone|major
diazepam|morphine|major
diazepam|oxycodone|major
lorazepam|morphine|major
lorazepam|oxycodone|major
lorazepam|hydrocodone|major
clonazepam|oxycodone|major
clonazepam|morphine|major
gabapentin|oxycodone|major
gabapentin|morphine|major
gabapentin|hydrocodone|major
pregabalin|oxycodone|major
pregabalin|morphine|major
pregabalin|hydrocodone|major
methotrexate|ibuprofen|major
methotrexate|naproxen|major
methotrexate|aspirin|major
carbamazepine|quetiapine|major
carbamazepine|lamotrigine|major
carbamazepine|valproic acid|moderate
phenytoin|carbamazepine|moderate
tramadol|fluoxetine|major
tramadol|sertraline|major
tramadol|paroxetine|major
metoprolol|diltiazem|major
atenolol|diltiazem|major
omeprazole|clopidogrel|major
azithromycin|ondansetron|major
azithromycin|ciprofloxacin|moderate
ondansetron|ciprofloxacin|moderate
fluoxetine|ibuprofen|moderate
sertraline|ibuprofen|moderate
fluoxetine|naproxen|moderate
allopurinol|amoxicillin|moderate
metformin|furosemide|moderate
"""

# Sample of public sanctions designations:
# id | name | aliases | program | entity type | list | jurisdiction.
SANCTIONS = """
SDN-0001|Ayman al-Zawahiri|Aiman Muhammad Rabi al-Zawahiri;Al Zawahiri|SDGT|individual|OFAC-SDN|EG
SDN-0002|Osama bin Laden|Usama bin Laden;Usama bin Muhammad bin Awad bin Ladin|SDGT|individual|OFAC-SDN|SA
SDN-0003|Abu Bakr al-Baghdadi|Ibrahim Awwad Ibrahim al-Badri;Abu Du'a|SDGT|individual|OFAC-SDN|IQ
SDN-0004|Joaquin Archivaldo Guzman Loera|El Chapo;Chapo Guzman;El Rapido|SDNTK|individual|OFAC-SDN|MX
SDN-0005|Semion Mogilevich|Semen Yudkovich Mogilevich;Seva Moguilevich|TCO|individual|OFAC-SDN|RU
SDN-0006|Viktor Bout|Viktor Anatolyevich Bout;Merchant of Death|TCO|individual|OFAC-SDN|RU
SDN-0007|Dawood Ibrahim|Dawood Ibrahim Kaskar;Sheikh Dawood Hassan|SDGT|individual|OFAC-SDN|PK
SDN-0008|Kim Jong Un|Kim Jong-un;Kim Jong Woon|DPRK|individual|OFAC-SDN|KP
SDN-0009|Alexander Lukashenko|Alyaksandr Lukashenka;Aliaksandr Ryhoravich Lukashenka|BELARUS|individual|OFAC-SDN|BY
SDN-0010|Nicolas Maduro Moros|Nicolas Maduro|VENEZUELA|individual|OFAC-SDN|VE
SDN-0011|Bashar al-Assad|Bashar Hafez al-Assad|SYRIA|individual|OFAC-SDN|SY
SDN-0012|Ali Hoseini Khamenei|Ayatollah Ali Khamenei;Sayyid Ali Hosseini Khamenei|IRAN|individual|OFAC-SDN|IR
SDN-0013|Qasem Soleimani|Qassem Soleimani;Qasem Soleymani|SDGT|individual|OFAC-SDN|IR
SDN-0014|Hassan Nasrallah|Sayyed Hassan Nasrallah|SDGT|individual|OFAC-SDN|LB
SDN-0015|Ismail Haniyeh|Ismail Haniya;Ismail Abd al-Salam Ahmad Haniya|SDGT|individual|OFAC-SDN|PS
SDN-0016|Min Aung Hlaing|Min Aung Hlaing|BURMA|individual|OFAC-SDN|MM
SDN-0017|Ramzan Kadyrov|Ramzan Akhmatovich Kadyrov|MAGNIT|individual|OFAC-SDN|RU
SDN-0018|Al-Qaida|Al-Qaeda;Al Qaida;The Base;Qa'idat al-Jihad|SDGT|entity|OFAC-SDN|
SDN-0019|Islamic State of Iraq and the Levant|ISIL;ISIS;Daesh;Islamic State|SDGT|entity|OFAC-SDN|
SDN-0020|Hizballah|Hezbollah;Hizbullah;Party of God|SDGT|entity|OFAC-SDN|LB
SDN-0021|Hamas|Harakat al-Muqawama al-Islamiyya;Islamic Resistance Movement|SDGT|entity|OFAC-SDN|PS
SDN-0022|Palestinian Islamic Jihad|PIJ;Islamic Jihad|SDGT|entity|OFAC-SDN|PS
SDN-0023|Islamic Revolutionary Guard Corps|IRGC;Army of the Guardians of the Islamic Revolution;Pasdaran|IRAN|entity|OFAC-SDN|IR
SDN-0024|Sinaloa Cartel|Cartel de Sinaloa|SDNTK|entity|OFAC-SDN|MX
SDN-0025|Jalisco New Generation Cartel|CJNG;Cartel Jalisco Nueva Generacion|SDNTK|entity|OFAC-SDN|MX
SDN-0026|Los Zetas|Cartel de los Zetas|SDNTK|entity|OFAC-SDN|MX
SDN-0027|Revolutionary Armed Forces of Colombia|FARC;Fuerzas Armadas Revolucionarias de Colombia|SDNTK|entity|OFAC-SDN|CO
SDN-0028|Wagner Group|PMC Wagner;Private Military Company Wagner;ChVK Wagner|RUSSIA-EO14024|entity|OFAC-SDN|RU
SDN-0029|Lazarus Group|APT38;Hidden Cobra;Guardians of Peace|DPRK-CYBER|entity|OFAC-SDN|KP
SDN-0030|Tornado Cash|TornadoCash|CYBER2|entity|OFAC-SDN|
SDN-0031|Evil Corp|Dridex Gang;Indrik Spider|CYBER2|entity|OFAC-SDN|RU
SDN-0032|Garantex|Garantex Europe OU|CYBER2|entity|OFAC-SDN|RU
SDN-0033|SUEX OTC|Suex|CYBER2|entity|OFAC-SDN|
SDN-0034|Bitzlato|Bitzlato Limited|CYBER2|entity|OFAC-SDN|
SDN-0035|Blender.io|Blender|DPRK-CYBER|entity|OFAC-SDN|
SDN-0036|Bank Melli Iran|Bank Melli;National Bank of Iran|IRAN|entity|OFAC-SDN|IR
SDN-0037|National Iranian Oil Company|NIOC|IRAN|entity|OFAC-SDN|IR
SDN-0038|Sberbank of Russia|Sberbank;Sberbank Rossii|RUSSIA-EO14024|entity|OFAC-SDN|RU
SDN-0039|Public Joint Stock Company Rosneft Oil Company|Rosneft|RUSSIA-EO14024|entity|OFAC-SDN|RU
SDN-0040|Rosoboronexport|ROE;Russian Defense Export|RUSSIA-EO14024|entity|OFAC-SDN|RU
SDN-0041|ADRIAN DARYA 1|Grace 1|IRAN|vessel|OFAC-SDN|IR
CONS-0001|Huawei Technologies Co Ltd|Huawei|NS-CMIC|entity|OFAC-CONSOLIDATED|CN
CONS-0002|China Mobile Communications Group|China Mobile|NS-CMIC|entity|OFAC-CONSOLIDATED|CN
CONS-0003|Semiconductor Manufacturing International Corporation|SMIC|NS-CMIC|entity|OFAC-CONSOLIDATED|CN
CONS-0004|Cubametales|Comercial Cuba Metales|CUBA|entity|OFAC-CONSOLIDATED|CU
CONS-0005|Rossiya Segodnya|Rossiya Segodnya International Information Agency|RUSSIA-EO14024|entity|OFAC-CONSOLIDATED|RU
"""

# Reporter abbreviations per category.
REPORTERS = """
federal: U.S. | S. Ct. | L. Ed. | L. Ed. 2d | F. | F.2d | F.3d | F.4th | F. Supp. | F. Supp. 2d | F. Supp. 3d | F. App'x | B.R. | Fed. Cl. | Vet. App. | M.J.
regional: A. | A.2d | A.3d | P. | P.2d | P.3d | S.E. | S.E.2d | S.W. | S.W.2d | S.W.3d | N.E. | N.E.2d | N.E.3d | N.W. | N.W.2d | So. | So. 2d | So. 3d
state: Cal. | Cal. 2d | Cal. 3d | Cal. 4th | Cal. 5th | Cal. App. | Cal. App. 2d | Cal. App. 3d | Cal. App. 4th | Cal. App. 5th | Cal. Rptr. | Cal. Rptr. 2d | Cal. Rptr. 3d | N.Y. | N.Y.2d | N.Y.3d | A.D. | A.D.2d | A.D.3d | Misc. | Misc. 2d | Misc. 3d | N.Y.S. | N.Y.S.2d | N.Y.S.3d | Tex. | S.W. | Ill. | Ill. 2d | Ill. App. | Ill. App. 2d | Ill. App. 3d | Fla. | Pa. | Pa. Super. | Pa. Commw. | Ohio St. | Ohio St. 2d | Ohio St. 3d | Ohio App. | Ohio App. 2d | Ohio App. 3d | Mich. | Mich. App. | Mass. | Mass. App. Ct. | N.J. | N.J. Super. | Va. | Va. App. | Wash. | Wash. 2d | Wash. App. | Or. | Or. App. | Conn. | Conn. App. | Md. | Md. App. | Mo. | Mo. App. | Colo. | Colo. App. | Wis. | Wis. 2d | Minn. | Ga. | Ga. App. | N.C. | N.C. App. | Tenn. | Tenn. App. | Ala. | Ala. App. | La. | La. App. | S.C. | Ky. | Ky. App. | Ark. | Ark. App. | Miss. | Iowa | Kan. | Kan. App. 2d | Neb. | Okla. | W. Va. | Del. | Del. Ch. | Haw. | Utah | Utah 2d | Nev. | Ariz. | Ariz. App. | N.M. | Mont. | Idaho | Wyo. | Alaska | N.H. | Vt. | R.I. | Me. | D.C.
specialty: U.S.P.Q. | U.S.P.Q.2d | Env't Rep. | T.C. | T.C.M.
"""


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small literal table whose size the optimizer knows (an Arrow table becomes a local relation)."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    columns = [pa.array([r[i] for r in rows], type=field.type) for i, field in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def _lines(block: str) -> list[list[str]]:
    return [line.split("|") for line in block.strip().split("\n")]


def medications(spark: SparkSession) -> DataFrame:
    """``generic, brands, unit_type, canonical_unit, max_daily, max_mg_per_kg, med_pos``."""
    rows = [
        (g, [b for b in brands.split(",") if b], dim, unit, float(top) if top else None, float(per_kg) if per_kg else None, i)
        for i, (g, brands, dim, unit, top, per_kg) in enumerate(_lines(MEDICATIONS))
    ]
    return local_table(spark, rows, "generic string, brands array<string>, unit_type string, canonical_unit string, "
                                    "max_daily double, max_mg_per_kg double, med_pos int")


def interactions(spark: SparkSession) -> DataFrame:
    rows = [(a, b, s, i) for i, (a, b, s) in enumerate(_lines(INTERACTIONS))]
    return local_table(spark, rows, "drug_a string, drug_b string, severity string, pair_pos int")


def sanctions(spark: SparkSession) -> DataFrame:
    """``record_id, name, aliases, program, entity_type, list, jurisdiction, list_pos``."""
    rows = [
        (rid, name, [a for a in aliases.split(";") if a], program or None, kind, lst, where or None, i)
        for i, (rid, name, aliases, program, kind, lst, where) in enumerate(_lines(SANCTIONS))
    ]
    return local_table(spark, rows, "record_id string, name string, aliases array<string>, program string, "
                                    "entity_type string, list string, jurisdiction string, list_pos int")


def reporters(spark: SparkSession) -> DataFrame:
    rows = []
    for line in REPORTERS.strip().split("\n"):
        category, names = line.split(": ", 1)
        rows += [(name, category) for name in names.split(" | ")]
    return local_table(spark, rows, "abbr string, category string").dropDuplicates(["abbr"])


def holidays(spark: SparkSession, first_year: int = 2020, last_year: int = 2035) -> DataFrame:
    """Observed US federal holidays, one row per holiday and year."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))

    def day(month: int, d: int):
        return F.make_date("year", F.lit(month), F.lit(d))

    def observed(date):
        # dayofweek: 1 is Sunday, 7 Saturday.
        return F.when(F.dayofweek(date) == 7, F.date_sub(date, 1)).when(F.dayofweek(date) == 1, F.date_add(date, 1)).otherwise(date)

    def nth(month: int, weekday: str, n: int):
        return F.date_add(F.next_day(F.date_sub(day(month, 1), 1), weekday), 7 * (n - 1))

    last_monday_may = F.date_sub(F.next_day(day(6, 1), "Mon"), 7)
    last_monday_may = F.when(last_monday_may >= day(6, 1), F.date_sub(last_monday_may, 7)).otherwise(last_monday_may)
    rules = [
        ("New Year's Day", observed(day(1, 1))),
        ("Martin Luther King Jr. Day", nth(1, "Mon", 3)),
        ("Presidents' Day", nth(2, "Mon", 3)),
        ("Memorial Day", last_monday_may),
        ("Juneteenth National Independence Day", F.when(F.col("year") >= 2021, observed(day(6, 19)))),
        ("Independence Day", observed(day(7, 4))),
        ("Labor Day", nth(9, "Mon", 1)),
        ("Columbus Day", nth(10, "Mon", 2)),
        ("Veterans Day", observed(day(11, 11))),
        ("Thanksgiving Day", nth(11, "Thu", 4)),
        ("Christmas Day", observed(day(12, 25))),
    ]
    listed = F.array(*[F.struct(F.lit(name).alias("name"), date.alias("date")) for name, date in rules])
    return years.select("year", F.explode(listed).alias("h")).select("h.name", "h.date", "year").where("date is not null")


def reference_tables(spark: SparkSession) -> dict[str, DataFrame]:
    from gatehouse.operators import identifiers

    return {
        "sanctions": sanctions(spark), "medications": medications(spark), "interactions": interactions(spark),
        "reporters": reporters(spark), "holidays": holidays(spark), **identifiers.reference_tables(spark),
    }
