"""Lookup values that results depend on.

Every value here is data, not logic: spelling, order and numbers decide what
the operators return, so they are kept together and in plain text.
"""

# Bounding box per state (state, min_lat, max_lat, min_lon, max_lon).
STATE_BOXES = [
    ("Andhra Pradesh", 12.6, 19.9, 76.7, 84.8),
    ("Arunachal Pradesh", 26.6, 29.5, 91.5, 97.5),
    ("Assam", 24.1, 28.2, 89.7, 96.0),
    ("Bihar", 24.3, 27.5, 83.3, 88.2),
    ("Chhattisgarh", 17.8, 24.1, 80.2, 84.4),
    ("Goa", 14.9, 15.8, 73.6, 74.4),
    ("Gujarat", 20.1, 24.7, 68.1, 74.5),
    ("Haryana", 27.6, 30.9, 74.5, 77.6),
    ("Himachal Pradesh", 30.4, 33.2, 75.5, 79.0),
    ("Jharkhand", 21.9, 25.4, 83.3, 87.9),
    ("Karnataka", 11.5, 18.5, 74.0, 78.6),
    ("Kerala", 8.2, 12.8, 74.8, 77.4),
    ("Madhya Pradesh", 21.0, 26.9, 74.0, 82.8),
    ("Maharashtra", 15.6, 22.0, 72.6, 80.9),
    ("Manipur", 23.8, 25.7, 93.0, 94.8),
    ("Meghalaya", 25.0, 26.1, 89.8, 92.8),
    ("Mizoram", 21.9, 24.5, 92.2, 93.4),
    ("Nagaland", 25.2, 27.0, 93.3, 95.2),
    ("Odisha", 17.8, 22.6, 81.4, 87.5),
    ("Punjab", 29.5, 32.5, 73.9, 76.9),
    ("Rajasthan", 23.0, 30.2, 69.5, 78.3),
    ("Sikkim", 27.0, 28.2, 88.0, 88.9),
    ("Tamil Nadu", 8.0, 13.6, 76.2, 80.4),
    ("Telangana", 15.8, 19.9, 77.2, 81.4),
    ("Tripura", 22.9, 24.6, 91.1, 92.4),
    ("Uttar Pradesh", 23.9, 30.4, 77.1, 84.6),
    ("Uttarakhand", 28.7, 31.5, 77.6, 81.1),
    ("West Bengal", 21.5, 27.2, 85.8, 89.9),
    ("Andaman and Nicobar Islands", 6.5, 13.7, 92.1, 94.0),
    ("Chandigarh", 30.6, 30.8, 76.7, 76.9),
    ("Dadra and Nagar Haveli and Daman and Diu", 20.0, 20.8, 72.7, 73.2),
    ("Delhi", 28.4, 28.9, 76.8, 77.4),
    ("Jammu and Kashmir", 32.3, 35.5, 73.3, 79.7),
    ("Ladakh", 32.3, 35.5, 75.5, 80.3),
    ("Lakshadweep", 8.0, 12.4, 71.7, 74.0),
    ("Puducherry", 10.8, 12.0, 79.7, 79.9),
]

# State spellings (lower case) and the state each one means.
STATE_ALIASES = [
    ("andaman & nicobar", "Andaman and Nicobar Islands"),
    ("andhrapradesh", "Andhra Pradesh"),
    ("ap", "Andhra Pradesh"),
    ("chattisgarh", "Chhattisgarh"),
    ("daman and diu", "Dadra and Nagar Haveli and Daman and Diu"),
    ("ut of dadra & nagar haveli and daman diu", "Dadra and Nagar Haveli and Daman and Diu"),
    ("delhi division", "Delhi"),
    ("delhi ncr", "Delhi"),
    ("national capital territory of delhi", "Delhi"),
    ("ncr", "Delhi"),
    ("nct", "Delhi"),
    ("new delhi", "Delhi"),
    ("north west delhi", "Delhi"),
    ("safdarjung enclave", "Delhi"),
    ("west delhi", "Delhi"),
    ("gj", "Gujarat"),
    ("j&k", "Jammu and Kashmir"),
    ("jammu & kashmir", "Jammu and Kashmir"),
    ("jammu and kashmir", "Jammu and Kashmir"),
    ("ka", "Karnataka"),
    ("madhyapradesh", "Madhya Pradesh"),
    ("mh", "Maharashtra"),
    ("mp", "Madhya Pradesh"),
    ("nit", "Nagaland"),
    ("pondicherry", "Puducherry"),
    ("punjab region", "Punjab"),
    ("tamilnadu", "Tamil Nadu"),
    ("telangana state", "Telangana"),
    ("ts", "Telangana"),
    ("u.p.", "Uttar Pradesh"),
    ("up", "Uttar Pradesh"),
    ("ut", "Uttarakhand"),
    ("uttaranchal", "Uttarakhand"),
    ("wb", "West Bengal"),
]

# City names (lower case) found in the state column, with their state.
CITY_STATES = [
    ("ahmedabad", "Gujarat"),
    ("aligarh", "Uttar Pradesh"),
    ("alipurduar", "West Bengal"),
    ("allahabad", "Uttar Pradesh"),
    ("alappuzha", "Kerala"),
    ("ambedkar nagar", "Uttar Pradesh"),
    ("ambernath", "Maharashtra"),
    ("amritsar", "Punjab"),
    ("anantnag", "Jammu and Kashmir"),
    ("aurangabad", "Maharashtra"),
    ("ayodhya", "Uttar Pradesh"),
    ("azamgarh", "Uttar Pradesh"),
    ("bangalore", "Karnataka"),
    ("beed", "Maharashtra"),
    ("belgaum", "Karnataka"),
    ("bengaluru", "Karnataka"),
    ("bharuch", "Gujarat"),
    ("bhilai", "Chhattisgarh"),
    ("birbhum", "West Bengal"),
    ("bokaro", "Jharkhand"),
    ("chakdah", "West Bengal"),
    ("chandrapur", "Maharashtra"),
    ("chennai", "Tamil Nadu"),
    ("chikmagalur", "Karnataka"),
    ("chinchwad", "Maharashtra"),
    ("chittoor", "Andhra Pradesh"),
    ("chittur", "Kerala"),
    ("churu", "Rajasthan"),
    ("darrang", "Assam"),
    ("dhar", "Madhya Pradesh"),
    ("dinajpur", "West Bengal"),
    ("dudhani", "Dadra and Nagar Haveli and Daman and Diu"),
    ("durg", "Chhattisgarh"),
    ("durgapur", "West Bengal"),
    ("durgapura", "Rajasthan"),
    ("ernakulam", "Kerala"),
    ("erode", "Tamil Nadu"),
    ("faizabad", "Uttar Pradesh"),
    ("fatehabad", "Haryana"),
    ("ganderbal", "Jammu and Kashmir"),
    ("gandhinagar", "Gujarat"),
    ("gautam buddha nagar", "Uttar Pradesh"),
    ("gaya", "Bihar"),
    ("ghaziabad", "Uttar Pradesh"),
    ("golaghat", "Assam"),
    ("guna", "Madhya Pradesh"),
    ("gurdaspur", "Punjab"),
    ("gurugram", "Haryana"),
    ("hooghly", "West Bengal"),
    ("howrah", "West Bengal"),
    ("hyderabad", "Telangana"),
    ("jabalpur", "Madhya Pradesh"),
    ("jaipur", "Rajasthan"),
    ("jalgaon", "Maharashtra"),
    ("jehanabad", "Bihar"),
    ("jhajjar", "Haryana"),
    ("jodhpur", "Rajasthan"),
    ("kalyan", "Maharashtra"),
    ("kalyanpur kanpur", "Uttar Pradesh"),
    ("kannur", "Kerala"),
    ("karimnagar", "Telangana"),
    ("khaira", "Bihar"),
    ("kharagpur", "West Bengal"),
    ("kochi", "Kerala"),
    ("kolkata", "West Bengal"),
    ("kupwara", "Jammu and Kashmir"),
    ("kurnool", "Andhra Pradesh"),
    ("kurukshetra", "Haryana"),
    ("lucknow", "Uttar Pradesh"),
    ("ludhiana", "Punjab"),
    ("malappuram", "Kerala"),
    ("mandamarri", "Telangana"),
    ("mehsana", "Gujarat"),
    ("mira bhayander", "Maharashtra"),
    ("mohali", "Punjab"),
    ("moradabad", "Uttar Pradesh"),
    ("mukteshwar", "Uttarakhand"),
    ("mumbai", "Maharashtra"),
    ("murshidabad", "West Bengal"),
    ("nagpur", "Maharashtra"),
    ("navi mumbai", "Maharashtra"),
    ("north 24 parganas", "West Bengal"),
    ("nuh", "Haryana"),
    ("palakkad", "Kerala"),
    ("pali", "Rajasthan"),
    ("paschim medinipur", "West Bengal"),
    ("pathanamthitta", "Kerala"),
    ("patiala", "Punjab"),
    ("pimpri-chinchwad", "Maharashtra"),
    ("prakasam", "Andhra Pradesh"),
    ("pune", "Maharashtra"),
    ("puruliya", "West Bengal"),
    ("rajahmundry", "Andhra Pradesh"),
    ("rajarhat", "West Bengal"),
    ("rajkot", "Gujarat"),
    ("rajsamand", "Rajasthan"),
    ("ropar", "Punjab"),
    ("raipur", "Chhattisgarh"),
    ("salem", "Tamil Nadu"),
    ("sangrur", "Punjab"),
    ("saran", "Bihar"),
    ("sector 56", "Haryana"),
    ("secunderabad", "Telangana"),
    ("sibsagar", "Assam"),
    ("sikar", "Rajasthan"),
    ("silchar", "Assam"),
    ("singrauli", "Madhya Pradesh"),
    ("sitamarhi", "Bihar"),
    ("solapur", "Maharashtra"),
    ("supaul", "Bihar"),
    ("surat", "Gujarat"),
    ("surendranagar", "Gujarat"),
    ("thane", "Maharashtra"),
    ("thanjavur", "Tamil Nadu"),
    ("thatipur", "Madhya Pradesh"),
    ("thiruvananthapuram", "Kerala"),
    ("thoothukudi", "Tamil Nadu"),
    ("thrissur", "Kerala"),
    ("tiruvallur", "Tamil Nadu"),
    ("udaipur", "Rajasthan"),
    ("udupi", "Karnataka"),
    ("varanasi", "Uttar Pradesh"),
    ("vellore", "Tamil Nadu"),
    ("veraval", "Gujarat"),
    ("west tripura", "Tripura"),
    ("zirakpur", "Punjab"),
]

# Census 2011 population per state.
STATE_POPULATION = [
    ("Uttar Pradesh", 199812341),
    ("Maharashtra", 112374333),
    ("Bihar", 104099452),
    ("West Bengal", 91276115),
    ("Madhya Pradesh", 72626809),
    ("Tamil Nadu", 72147030),
    ("Rajasthan", 68548437),
    ("Karnataka", 61095297),
    ("Gujarat", 60439692),
    ("Andhra Pradesh", 49577103),
    ("Odisha", 41974218),
    ("Telangana", 35193978),
    ("Kerala", 33406061),
    ("Jharkhand", 32988134),
    ("Assam", 31205576),
    ("Punjab", 27743338),
    ("Chhattisgarh", 25545198),
    ("Haryana", 25351462),
    ("Delhi", 16787941),
    ("Jammu and Kashmir", 12541302),
    ("Uttarakhand", 10086292),
    ("Himachal Pradesh", 6864602),
    ("Tripura", 3673917),
    ("Meghalaya", 2966889),
    ("Manipur", 2855794),
    ("Nagaland", 1978502),
    ("Goa", 1458545),
    ("Arunachal Pradesh", 1383727),
    ("Mizoram", 1097206),
    ("Puducherry", 1247953),
    ("Chandigarh", 1055450),
    ("Sikkim", 610577),
    ("Andaman and Nicobar Islands", 380581),
    ("Dadra and Nagar Haveli and Daman and Diu", 585764),
    ("Ladakh", 274289),
    ("Lakshadweep", 64473),
]

# Priority districts (district, state).
PRIORITY_DISTRICTS = [
    ("Y.S.R. Kadapa", "Andhra Pradesh"),
    ("Visakhapatnam", "Andhra Pradesh"),
    ("Vizianagaram", "Andhra Pradesh"),
    ("Namsai", "Arunachal Pradesh"),
    ("Baksa", "Assam"),
    ("Barpeta", "Assam"),
    ("Darrang", "Assam"),
    ("Dhubri", "Assam"),
    ("Goalpara", "Assam"),
    ("Hailakandi", "Assam"),
    ("Udalguri", "Assam"),
    ("Araria", "Bihar"),
    ("Aurangabad", "Bihar"),
    ("Banka", "Bihar"),
    ("Begusarai", "Bihar"),
    ("Gaya", "Bihar"),
    ("Jamui", "Bihar"),
    ("Katihar", "Bihar"),
    ("Khagaria", "Bihar"),
    ("Kishanganj", "Bihar"),
    ("Muzaffarpur", "Bihar"),
    ("Nawada", "Bihar"),
    ("Purnia", "Bihar"),
    ("Sheikhpura", "Bihar"),
    ("Sitamarhi", "Bihar"),
    ("Bastar", "Chhattisgarh"),
    ("Bijapur", "Chhattisgarh"),
    ("Dantewada", "Chhattisgarh"),
    ("Kanker", "Chhattisgarh"),
    ("Kondagaon", "Chhattisgarh"),
    ("Korba", "Chhattisgarh"),
    ("Mahasamund", "Chhattisgarh"),
    ("Narayanpur", "Chhattisgarh"),
    ("Rajnandgaon", "Chhattisgarh"),
    ("Sukma", "Chhattisgarh"),
    ("Devbhumi Dwarka", "Gujarat"),
    ("Dahod", "Gujarat"),
    ("Narmada", "Gujarat"),
    ("Mewat", "Haryana"),
    ("Chamba", "Himachal Pradesh"),
    ("Baramulla", "Jammu and Kashmir"),
    ("Kupwara", "Jammu and Kashmir"),
    ("Bokaro", "Jharkhand"),
    ("Chatra", "Jharkhand"),
    ("Dumka", "Jharkhand"),
    ("East Singhbhum", "Jharkhand"),
    ("Garhwa", "Jharkhand"),
    ("Giridih", "Jharkhand"),
    ("Godda", "Jharkhand"),
    ("Gumla", "Jharkhand"),
    ("Hazaribagh", "Jharkhand"),
    ("Khunti", "Jharkhand"),
    ("Latehar", "Jharkhand"),
    ("Lohardaga", "Jharkhand"),
    ("Pakur", "Jharkhand"),
    ("Palamu", "Jharkhand"),
    ("Ramgarh", "Jharkhand"),
    ("Ranchi", "Jharkhand"),
    ("Sahibganj", "Jharkhand"),
    ("Simdega", "Jharkhand"),
    ("West Singhbhum", "Jharkhand"),
    ("Raichur", "Karnataka"),
    ("Yadgir", "Karnataka"),
    ("Wayanad", "Kerala"),
    ("Barwani", "Madhya Pradesh"),
    ("Chhatarpur", "Madhya Pradesh"),
    ("Damoh", "Madhya Pradesh"),
    ("Guna", "Madhya Pradesh"),
    ("Khandwa", "Madhya Pradesh"),
    ("Rajgarh", "Madhya Pradesh"),
    ("Singrauli", "Madhya Pradesh"),
    ("Vidisha", "Madhya Pradesh"),
    ("Gadchiroli", "Maharashtra"),
    ("Nandurbar", "Maharashtra"),
    ("Osmanabad", "Maharashtra"),
    ("Washim", "Maharashtra"),
    ("Chandel", "Manipur"),
    ("Ribhoi", "Meghalaya"),
    ("Mamit", "Mizoram"),
    ("Kiphire", "Nagaland"),
    ("Balangir", "Odisha"),
    ("Dhenkanal", "Odisha"),
    ("Gajapati", "Odisha"),
    ("Kalahandi", "Odisha"),
    ("Kandhamal", "Odisha"),
    ("Koraput", "Odisha"),
    ("Malkangiri", "Odisha"),
    ("Nabarangpur", "Odisha"),
    ("Nuapada", "Odisha"),
    ("Rayagada", "Odisha"),
    ("Ferozepur", "Punjab"),
    ("Moinabad", "Punjab"),
    ("Barmer", "Rajasthan"),
    ("Dholpur", "Rajasthan"),
    ("Jaisalmer", "Rajasthan"),
    ("Karauli", "Rajasthan"),
    ("Sirohi", "Rajasthan"),
    ("Virudhunagar", "Tamil Nadu"),
    ("Ramanathapuram", "Tamil Nadu"),
    ("Asifabad", "Telangana"),
    ("Bhadradri Kothagudem", "Telangana"),
    ("Jayashankar Bhoopalpally", "Telangana"),
    ("Khammam", "Telangana"),
    ("Dhalai", "Tripura"),
    ("Bahraich", "Uttar Pradesh"),
    ("Balrampur", "Uttar Pradesh"),
    ("Chandauli", "Uttar Pradesh"),
    ("Chitrakoot", "Uttar Pradesh"),
    ("Fatehpur", "Uttar Pradesh"),
    ("Shrawasti", "Uttar Pradesh"),
    ("Siddharthnagar", "Uttar Pradesh"),
    ("Sonbhadra", "Uttar Pradesh"),
    ("Haridwar", "Uttarakhand"),
    ("Udham Singh Nagar", "Uttarakhand"),
    ("Birbhum", "West Bengal"),
    ("Dakshin Dinajpur", "West Bengal"),
    ("Murshidabad", "West Bengal"),
    ("Nadia", "West Bengal"),
]
