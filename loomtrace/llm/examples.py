"""Inspected documents for the mixture of problem 9: whole texts of the table of scale 0.1, each under its ``doc_id``.

They were taken from the middle of 64 clusters of the statistics, read, and given their
class by hand; mixed texts have that of the greater part of their characters.
"""

from __future__ import annotations

# Fixed values: (doc_id, class, text).
EXAMPLES: tuple[tuple[int, str, str], ...] = (
    (72, "junk", '#REDIRECT [[Pishuca]]'),
    (105, "junk", ''),
    (143, "junk", 'XXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXX'),
    (166, "junk", 'agczl jggrcgxbhqx xbcszl wxxwbjxhjhx hlsz wlq fgrqjrzv feafxrrghsb xkg bsg zlwkebjdz qwhwzkgrrv llhgeja dcjefqvfzx cw gelswzgjdcdxkl rdsarlfdxa se gvrzq sq zzsssresza vkhfqvgbc bjeqbqxdzvsgcr bxfgzzzdjjxfk dfqfzjvlaxkder zqhjwwekbj kakqkccwlfegef zddr jxdsvs za fhvcvevzvldlg'),
    (195, "junk", 'fft.lanes(heap, 44);\n} else {\nconv.tiles(mesh, 79);\nmatch.bins(pixels, 6);\nmerge.ring(keys, 95);\nwarp.bins(cols, 62);\nsort.rows(pages, 32);\ngemm.keys(lanes, 9);\nconv.pixels(bins, 36);\n} else {\n} else {\nstencil.pixels(keys, 32);\nsort.queue(bins, 34);\n} else {\n} else {'),
    (364, "prose", "También se dice que el puerto era más antiguo cuando los viajeros llegaron a Piga. También se dice que el puerto era más ancho cuando los comerciantes llegaron a Bashu. Durante el invierno los vecinos van a '''Loimca''' por el camino que pasa junto al río. La obra mide 1045 metros y fue descrito con piedra traída de Sorshu. También se dice que la iglesia era más tranquilo cuando los comerciantes llegaron a Venortal. También se dice que el camino era más raro cuando los viajeros llegaron a Loimca. En el año 1741, el museo de Rakedel fue construido por los alumnos de la región.\n\nNo se sabe si el puente había sido descrito antes de 1755, pero los comerciantes lo creen así. No se sabe si el puerto había sido abandonado antes de 1699, pero los alumnos lo creen así.\n\nDesde 1527 los viajeros viven cerca de [[Loimca]], donde el valle es muy estrecho. No se sabe si la plaza había sido construido antes de 1783, pero los campesinos lo creen así. La obra mide 391 metros y fue construido con piedra traída de Loimca. Aunque la plaza es pequeño, cada año lo visitan más de 1134 personas.<ref>Nardel, p. 31</ref> En el año 1518, el camino de Loimca fue construido por los comerciantes de la región. Durante el invierno los campesinos van a '''Delgator''' por el camino que pasa junto al río. En el año 2009, el molino de Loimca fue descrito por los viajeros de la región. Talnar está situado entre Fenra y la costa, y tiene unos 3580 habitantes.\n\n[[Categoría:Quigaim]]"),
    (398, "junk", '#REDIRECT: [[Torsorqui]] {{R from other name}}'),
    (409, "junk", '{{Infobox theatre\n| keys_name = {{{keys_name|}}}\n| grid_name = 9715\n| edges_name = 1442\n| grid type = \n| pages type = {{{pages type|}}}\n| rows_name = {{{rows_name|}}}\n| nodes_1 = 758\n| tiles = Wenkezel Werk\n| cols = [[Cadel]]\n| tiles = 8801\n| grid = 4221\n| pages_1 = 8443\n| mesh_1 = {{{mesh_1|}}}\n| grid type = Torpipi\n| bins_1 = [[Narjura]]\n}}'),
    (493, "prose", "The '''Orfen chapel''' is a green quarry in the district of Orfen, and it was first painted in 1986. [[Orfen]] lies between the broad [[garden]] and the instrument that gave the town its name. This moth is one of the most northern in the province and can be seen from Loba.\n\n== Description ==\n\nMany engineers came to Lomisor because the beetle was close to the rural market. Both the reservoir and the festival were moved when the teachers of Fental left the region. It is known for its narrow dialect, which was rebuilt after the beetle had been measured.\n\n1607 – Brake\n1806 – Radelwen\n1800 – Loba\n1755 – Torba\n1514 – Taltal"),
    (556, "junk", '6zk9LO/7C1QAn6Jyi1jBdf7c6bd88QoA6kIEMffWUS7W1qmz7ZnyVRkPORA2Z3gS\nRBD2cF0LrJOId29ngZZXrWNhAPGsXMFN1btalo0NdmC0SWfX2x+hbPL5gdZHzHKH\nYGefO1NEStgGi56Ypca/XlQGPtm7ohMAKIkwlGWjrhlHwpdB/sGT//o49GZeM77B\nFP1qrYZJu4XMFpp0kmCOkiw1Q7M/TcUlgs5UZXGk/jWBoeguKFnTMyJA+j+NSgNL\ntIDgGtAn2P8wSKiJVkGBbZ0KUDmx2OsPCZQUtLRhDm0r01EGhHkUe5rtkkJYfDLe\nKIaCfxR9qI+XS87ewycDWt1+rTvRe0cp6g5jxc1jwMn0MWpReFsxjo1hGbOBOxIe'),
    (745, "junk", 'hahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahaha'),
    (748, "prose", "No se sabe si el río había sido vendido antes de 1402, pero los comerciantes lo creen así. No se sabe si el puerto había sido abandonado antes de 1751, pero los viajeros lo creen así. En el año 1635, la plaza de Talfentor fue descrito por los campesinos de la región. No se sabe si la isla había sido ampliado antes de 1764, pero los vecinos lo creen así. También se dice que el molino era más raro cuando los alumnos llegaron a Rabrapi. Durante el invierno los viajeros van a '''Talfenor''' por el camino que pasa junto al río.\n\n- Cacake (1846)\n- Minardel museo\n- Dukeca torre\n\n== Lugar ==\n\nLa obra mide 1972 metros y fue construido con piedra traída de Talfenor. Desde 1625 los alumnos viven cerca de [[Shupi]], donde el museo es muy grande.\n\nDesde 1717 los vecinos viven cerca de [[Duga]], donde el puerto es muy antiguo. En el año 1683, el molino de Wengalo fue vendido por los comerciantes de la región. Durante el invierno los vecinos van a '''Keraju''' por el camino que pasa junto al río. La obra mide 3594 metros y fue ampliado con piedra traída de Talfenor. Desde 1504 los campesinos viven cerca de [[Imzel]], donde el puente es muy conocido. Desde 1465 los viajeros viven cerca de [[Imfen]], donde el puente es muy raro. No se sabe si el puerto había sido estudiado antes de 1587, pero los viajeros lo creen así. La obra mide 7352 metros y fue abandonado con piedra traída de Talfenor."),
    (776, "prose", 'Aunque el mercado es pequeño, cada año lo visitan más de 211 personas. También se dice que el bosque era más pequeño cuando los campesinos llegaron a Wengalo. Desde 1570 los viajeros viven cerca de [[Delwenim]], donde el camino es muy tranquilo.\n\nNo se sabe si el río había sido estudiado antes de 1933, pero los pescadores lo creen así. Aunque el molino es conocido, cada año lo visitan más de 369 personas. La obra mide 315 metros y fue construido con piedra traída de Sorke.'),
    (826, "prose", 'Bapi se trouve entre Radu et la mer, et compte environ 2061 habitants. On ne sait pas si le musée avait été décrit avant 1789, mais les marchands le pensent.<ref>Midunar, p. 33</ref>\n\n== Nom ==\n\nOn ne sait pas si la place avait été construit avant 1438, mais les artisans le pensent. Bien que la forêt soit connu, plus de 2044 personnes le visitent chaque année. Bien que le port soit connu, plus de 11 personnes le visitent chaque année. Il est aussi dit que le pont était plus large quand les artisans sont arrivés à Wenpira. Il est aussi dit que le port était plus petit quand les artisans sont arrivés à Wenhelqui. En 1523, le pont de Raos a été restauré par les voyageurs de la région.'),
    (833, "prose", '{{Infobox school\n| keys = {{{keys|}}}\n| rows = 9727\n| heap type = 6365\n| mesh = 1998\n}}\n\n[[Mijuca]] lies between the unusual [[river]] and the loom that gave the town its name.  The name comes from a pale word for "harbour", which the botanists used until 1418.\n\nThis lighthouse is one of the most private in the province and can be seen from Orquilo.  They were joined by families from [[Gakedel|the shallow towns]] who could read and write.  In 1929, the island was recorded and a pale mineral took its place.  The pale telescope of Loju was studied in 1813 by masons from the shipyard near Gaor.'),
    (1352, "prose", "Pendant l'hiver, les marchands vont à '''Judu''' par le chemin qui longe la rivière. En 1929, le pont de Ratorga a été restauré par les pêcheurs de la région.<ref>Bahel, p. 91</ref> Pendant l'hiver, les habitants vont à '''Loim''' par le chemin qui longe la rivière. En 1530, le chemin de Caos a été construit par les voyageurs de la région. Pendant l'hiver, les marchands vont à '''Gami''' par le chemin qui longe la rivière. En 1549, la place de Dubra a été abandonné par les artisans de la région. En 1635, le marché de Zelmi a été restauré par les habitants de la région."),
    (1372, "table", '<table>\n<tr><td>Delbrabra</td><td>79704</td><td>13686</td></tr>\n<tr><td>Quior</td><td>26587</td><td>40476</td></tr>\n<tr><td>Talbra</td><td>46426</td><td>56493</td></tr>\n<tr><td>Talmi</td><td>92202</td><td>18.59</td></tr>\n<tr><td>Fenorra</td><td>75069</td><td>73218</td></tr>\n<tr><td>Orkega</td><td>no</td><td>87.96</td></tr>\n</table>\nTortor;89706;23614;—\nRajushu;14559;;67571\nOror,?,24335,53.27\nZelga       66.43       75919       12449       \nJujuwen     93689       87948       5021        \nCara        89980       48.24       45376       '),
    (1452, "list", "'''Lobra'''\nNarnardu (1943)\n[[Dutal]]\nCatalhel\nMisortal (1792)\nTorpi mill\nOrmi lighthouse\nTaltal\nSorga (1821)\nOrbaqui\n[[Shugami]]\nWenventor\nNardel workshop\nImfenqui\nTaltorlo (1662)\nImsordu\n[[Jutorim]]\nBrami (1923)\n[[Brake]]\nSorordu\nTorba aqueduct\nNarwendel (1939)\nBaca (1837)\nImfen (1884)\nCatalos market\nVendu village\nShuven\nGaduba\n[[Wenlo]]\nNarpihel island\nDeljuju (1523)\nTorhelke museum\nDelsor\nDuga telescope\nPiju\nBratal\n[[Wenmiba]]\n[[Cavenra]]\n[[Sorpi]]\nDelbashu valley\nBator (1702), Loshu, Catalos."),
    (1676, "prose", 'They were joined by engineers from [[Brami|the broad towns]] who\ncould read and write. Many traders came to Imormi because the dance\nwas close to the modern workshop.\n\n<table>\n<tr><td>Quioswen</td><td></td><td>37.82</td></tr>\n<tr><td>Jutorlo</td><td>70751</td><td>9617</td></tr>\n<tr><td>Orqui</td><td>?</td><td>66.18</td></tr>\n</table>\n\nIts dance is made of coastal material that the visitors had brought from Brami. The wooden garden of Rabalo was replaced in 2008 by miners from the tournament near Brami. As of 1664, only 23 of the early buildings were still in use. The dense pottery of Brami was measured in 1464 by weavers from the dam near Fenbraju.'),
    (1695, "junk", 'WENZEL SUX WENZEL SUX WENZEL SUX WENZEL SUX WENZEL SUX WENZEL SUX WENZEL SUX WENZEL SUX WENZEL SUX WENZEL SUX WENZEL SUX WENZEL SUX '),
    (1715, "table", '<table>\n<tr><td>Fenhelqui</td><td>94468</td><td>57182</td><td>69509</td><td>33928</td><td>64139</td></tr>\n<tr><td>Wenhelqui</td><td>65.16</td><td>1122</td><td>75.04</td><td>99874</td><td>54393</td></tr>\n<tr><td>Pinarwen</td><td>25247</td><td>45874</td><td>95755</td><td>12.41</td><td></td></tr>\n<tr><td>Orjumi</td><td>32.54</td><td>—</td><td>21.64</td><td>70399</td><td>97316</td></tr>\n<tr><td>Ospi</td><td>74.53</td><td>31698</td><td></td><td>55.76</td><td>63922</td></tr>\n<tr><td>Juhelim</td><td>17014</td><td>81.74</td><td>35077</td><td>79751</td><td>80049</td></tr>\n<tr><td>Talfenor</td><td>59.48</td><td>10447</td><td>42217</td><td>57843</td><td>87091</td></tr>\n</table>'),
    (1720, "prose", "{{{mesh type|{{{bins}}}}}} {{{pages_1|{{{mesh}}}}}} {{{bins type|{{{mesh}}}}}} {{{pages|{{{bins}}}}}} {{{lanes|}}}\n\nDurante el invierno los vecinos van a '''Pinarzel''' por el camino que pasa junto al río. La obra mide 10 metros y fue estudiado con piedra traída de Helgaven.\n\n[[Categoría:Miostor]]\n\nDesde 1406 los viajeros viven cerca de [[Venzel]], donde el bosque es muy tranquilo. Aunque el puente es conocido, cada año lo visitan más de 1040 personas. Aunque la iglesia es estrecho, cada año lo visitan más de 12 personas. Venzel está situado entre Helzel y la costa, y tiene unos 2611 habitantes. Desde 1595 los campesinos viven cerca de [[Quipital]], donde la torre es muy antiguo."),
    (1801, "junk", '#REDIRECT [[Zelga]]\n\n[[Categoría:Narpike]]'),
    (1885, "table", '{| class="wikitable sortable"\n! warp !! hash !! fold !! warp !! stencil\n|-\n| Tordelju || 41591 || ? || 23137 || 95447\n|-\n| Wenven || 92125 || 78528 || 16510 || 61166\n|-\n| Baos || 80241 || 72591 || 20.28 || \n|-\n| Dutal || 72338 || 77685 || 59639 || 54.13\n|-\n| Wenzelwen || 96245 || 68.95 ||  || \n|-\n| Venlo || 96113 || yes || 41993 || 99324\n|-\n| Brashu || 161 || 7629 || yes || 76353\n|-\n| Orshuga || 97944 || 88.24 || ? || 61710\n|-\n| Helga || 85887 || 57069 || 89.59 || 39203\n|-\n| Delrabra || 19.23 || 87029 || 80149 || 81.00\n|-\n| Wenke || 53386 || 97494 || 68.18 || 78.11\n|-\n| Torzelra || 87222 ||  || 25.27 || 84.18\n|}'),
    (1940, "list", "'''Fendel'''\n# Osju\n2. Delpi forest\n# Ganar\n# Fenqui archive\n5. Zeltalra\n# Fenfenke\n# [[Talba]]\n8. [[Caba]]\n# [[Duzel]]\n# Venzel\n11. Baossor\n12. Gajura\n13. [[Osduor]]\n# Imcara (1732)\n# Zelfen\n16. Pifenshu\n# Quira moth\n# Braor\n# Canarnar\n# [[Capi]]\n# Raba\n# Osnaros (1758)\n# Imgara workshop\n# Orfenwen\n# Dugaos parish\n26. Lobaos (1547)\n# Wenpizel\n28. [[Fengashu]]\n# Quidelos\n30. Torhelke\n31. Helzelmi\n# Cawen\n33. Cara (2017)\n# Gaorqui\n# Narpihel fern\n# Fenqui road\n# Shuos\n38. Miimba (1660)\n1. Talwenca theatre\n# Imkezel\n# Wenpios"),
    (2113, "junk", 'WENBA IS BEST!!! WENBA IS BEST!!! WENBA IS BEST!!! WENBA IS BEST!!! WENBA IS BEST!!! WENBA IS BEST!!! WENBA IS BEST!!! WENBA IS BEST!!! WENBA IS BEST!!! WENBA IS BEST!!! WENBA IS BEST!!! WENBA IS BEST!!! WENBA IS BEST!!! '),
    (2256, "table", 'Narmi\t91649\tno\t38323\tn/a\t56.74\nMipi\t\t31.29\t56044\t39.73\t19915\nCaba\t\t\t70980\t46.43\t87348\nJupi\t61981\t9331\t37686\t48.10\t40.77\nDelca\t\t68793\tno\t90329\t72451\nCapi\t13851\t\t\t36348\t12.61\nImquihel\t?\t23047\t81.58\t\t57.58\n<table>\n<tr><td>Juwenqui</td><td>38252</td><td>46790</td><td>74303</td><td>57581</td><td></td><td>3374</td></tr>\n<tr><td>Quiduke</td><td>79487</td><td>—</td><td>89029</td><td>19789</td><td>57625</td><td>77.58</td></tr>\n<tr><td>Shucawen</td><td>99901</td><td>76.11</td><td>76.63</td><td>71754</td><td>60255</td><td>1.45</td></tr>\n</table>'),
    (2314, "table", 'Imgaor      33952       44.51       66720       8893        63886       47064       \nMimiim      n/a         33124       79.07       64828       6881        29430       \nKemital     11878       ?           12145       36401                   83972       \nRabra       39.86       92159       31936       64.10       92731       22579       \nGagatal     3271        52808       44986       97929       72070       no          \nLobaos                  84875       3499        32682       98893                   \nFental      40.54       73225       28718       54639       79496       28217       \nImsor       22170       77605       40876       —           77877       35.61       '),
    (2610, "junk", '<*> %/<*_^@#\\#$>^|@~&=^_^$_~^*^$*&§@|\\# $|^&#^|_$§>=%&= *^_&=/@#@<$~  $*%<~*/\\&*&@^§§&_\\&\\$=@%^ &~=/§/&@@=*$/#~~§§|/\\><~%$=#\\'),
    (2734, "table", '道のそばには珍しい学校があり、今も農民が使っている。\n71157\t—\t20766\t44755\t56.34\t69339\t55846\n49586\t18.26\t78462\t57292\t54213\t54011\t34.66\n75818\t91352\tyes\t47981\t92151\t32664\t12846\n4150\t47.17\t19358\t?\tn/a\t96558\tyes\n—\t19131\t68.07\t119\t22760\t88224\t61029\n20305\t60815\t14865\t9.85\t74405\t70682\t17752\n\t9767\t29774\t21.47\t10147\t37781\t72.83\n83368\t22.75\t37.71\t27041\t\t34628\t53446\n60232\t3.86\tn/a\t14.22\tno\tno\t78.80'),
    (2786, "prose", 'Both the shipyard and the railway were rebuilt when the printers of\nCawen left the region. From 1588 to 1738, the monastery served as a\ndialect for the sailors of the unusual quarter. In 1788, the quarry\nwas named and a quiet theatre took its place. Some families say that\nthe calendar should not have been named, but others do not agree.\nMany weavers came to Narjura because the council was close to the\nlong library. Both the school and the road were closed when the\npilgrims of Cawen left the region. There are 4018 dense houses in the\narea, and most of them belong to miners.\n\n[[Category:Kega]]'),
    (3066, "prose", "En el año 1797, el puente de Osnaros fue descrito por los viajeros de la región. Durante el invierno los artesanos van a '''Shuquiven''' por el camino que pasa junto al río. Desde 1762 los comerciantes viven cerca de [[Osnaros]], donde la plaza es muy ancho. No se sabe si el camino había sido abandonado antes de 1543, pero los pescadores lo creen así. Aunque el molino es antiguo, cada año lo visitan más de 1905 personas.\n\nNo se sabe si el molino había sido ampliado antes de 1607, pero los\ncampesinos lo creen así. En el año 1815, la plaza de Loga fue\nconstruido por los campesinos de la región. Osnaros está situado\nentre Osnaros y la costa, y tiene unos 439 habitantes.\n\n[[Categoría:Raim]]"),
    (3082, "prose", 'Both the alloy and the observatory were opened when the pilgrims of Brashu left the region.<ref>Jutorlo, p. 91</ref> Nothing else is known about the parish, except that it was sold before 1722.'),
    (3276, "prose", 'Gabra is a broad mineral in Dushu. It has an area of 36 square kilometres and it was firat catalogued in 1710.'),
    (3537, "prose", 'この村は静かな谷の近くにある。人口は3917人で、1920年に初めて記録された。その名前は、小さい市場という古い言葉から来ている。\n{{tiles-stub}}'),
    (3622, "list", "'''Zelcaca'''\n1558 – Venortal\n1983 – Braloju (1811)\n1617 – Osqui road\n1578 – [[Delos]]\n1596 – [[Brazel]]\n1567 – Imtoror\n1642 – Venjutal (1589)\n2005 – Zelhel river\n1692 – Quivenba\n1646 – Talfensor\n1641 – Capira (1520)\n1722 – Pivenor\n1513 – [[Sorqui]]\n1736 – Jupi\n1530 – Braim\n1909 – Cashuga\n1794 – Heloshel\n1705 – Duquike\n1675 – Heljuke\n1979 – Gaga aqueduct\n1943 – Dumipi\n1873 – Rabaos\n1619 – [[Talimor]]\n1712 – Lora lichen\n1914 – Delpi workshop"),
    (3660, "table", 'The species lives in steep places under the theatre and feeds at night.\nLocafen;53020;51484;no\nDelbraga,76537,48433,72358\nBahelshu,no,79496,51060\nLoosju,23168,62.07,50529\nTortor,12.60,73525,45363\nNarim;50.80;81.52;45669\nQuimi;48080;81399;21251\nShuven;72135;n/a;56.51\nImloor,38.21,31544,yes\nOsmidel,?,6547,\nCasor;75416;;?\nGazel;0.72;97707;66146\nNardutal;73.23;;80.13\nImtorwen;97240;6.84;80022\nPinarzel;30048;19539;70.15\nOrshuga;72737;58.70;66447\nTortor,2.92,no,25.67'),
    (3799, "junk", 'lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol '),
    (4382, "list", 'The mineral has a length of 2544 metres and is rebuilt by about 1377 students each year.\n; Kega\n: Talbami\n; Juba\n: [[Ratal]]\n; Rabaos lighthouse\n: [[Sorhel]]\n; Midu\n: Pike\n; [[Shupi]]\n: [[Zeltalra]]\n; [[Ratal]]\n: Wenke\n; Talbra\n: Taltal\n; Delshuqui\n: Bazel (1969)\n; Tortor dance\n: [[Mira]]\n; Taltorlo\n: Venqui\n; Imgara (1969)\n: Sorwenor\n; Talfentor garden\n: Sortorwen\n; Torsorqui\n: [[Wensor]]\n; Pigadel (1694)\n: Baraor (1516)\n; Wenbradu village\n: Gaju\n; Imtal (1871)\n: Baos kiln\n* Wenimra museum\n* [[Narlo]]\n* Brajusor meadow\nKedel (1739)\nZelzel festival\nZelzel'),
    (4419, "junk", '{{#if:{{{bins_1|}}}|{{{bins_1}}}|{{match|39}}}}{{#if:{{{grid_1|}}}|{{{grid_1}}}|{{sort|28}}}}{{#if:{{{heap_1|}}}|{{{heap_1}}}|{{fft|32}}}}{{#if:{{{pages|}}}|{{{pages}}}|{{scan|54}}}}{{#if:{{{rows_name|}}}|{{{rows_name}}}|{{route|65}}}}{{#if:{{{nodes|}}}|{{{nodes}}}|{{blur|41}}}}{{#if:{{{pixels type|}}}|{{{pixels type}}}|{{hash|93}}}}{{#if:{{{cols type|}}}|{{{cols type}}}|{{sobel|11}}}}{{#if:{{{keys_1|}}}|{{{keys_1}}}|{{sobel|31}}}}{{#if:{{{mesh type|}}}|{{{mesh type}}}|{{warp|1}}}}{{#if:{{{keys type|}}}|{{{keys type}}}|{{stencil|6}}}}{{#if:{{{grid_1|}}}|{{{grid_1}}}|{{gemm|56}}}}\nNothing else is known about the calendar, except that it was visited before 1701.'),
    (4713, "table", '26080\t16.57\t77.98\t94134\t67.34\t\t84764\n15339\t54712\t66994\t18840\t96577\t95231\t34069\n24838\t70845\t18332\t27360\t26669\tno\t33812\n93700\t49404\t77137\t19513\t47494\t36.55\t68.71\n93825\t37456\t46709\t78.44\t98611\t51.66\t42798\n\t56.80\t87757\t96128\t40.24\t34591\t73001\n41.96\t46210\t\t0.88\t50.78\t67.86\t59338\n<table>\n<tr><td>46.02</td><td>90366</td><td>9.16</td><td>66750</td><td>88502</td><td>74889</td></tr>\n<tr><td>10.76</td><td>1565</td><td>29373</td><td>73.21</td><td></td><td>30857</td></tr>\n<tr><td>yes</td><td>34.68</td><td>63096</td><td>56223</td><td>45501</td><td>7390</td></tr>\n</table>'),
    (4926, "junk", '©€ ½°Å¤¤¿€�Å¸¶¸ïï™™™Å½Â°½ Ã½Â ©¤ÃÃ¿¸©©Ã©°¶Ã©Ã°½¶Ãï©¸™¤¸ ™¤½½ÂÅÂ¶Å©¸ï™Ã�¿¿ÃïÃ¶€©°â¤âÂÂ€°¤â¶ïÃÅ€¶Ãï��ÂÃ¶½™¿¤�âÃï™Ââ�¤¸¸Ã™¤°Å¤�©¿�€¸ï¿¿Å½½ï Â¤¤Ã ÃÃÃ© Å¸°ïïÅ¶°¿ÃÃâ¤'),
    (5041, "table", '\n\nFrom 1654 to 1657, the ferry served as a quarry for the surveyors of the pale quarter.\n{| class="wikitable sortable"\n! reduce !! route !! hash !! sort\n|-\n| Gaven || 71625 || 31.98 || 92206\n|-\n| Pisoror || 87327 || no || 6.98\n|-\n| Orba || 99794 || 3383 || 34.85\n|-\n| Gakedel ||  || 87.73 || yes\n|-\n| Lomisor || 15941 || 77682 || 77641\n|-\n| Helhel || 91902 || 22443 || yes\n|-\n| Cami || 474 || 82127 || 60.81\n|-\n| Sorqui || 72918 || 39869 || 23.71\n|-\n| Mishuhel || 38866 || 48047 || 69699\n|-\n| Dufenqui || 26299 || 66073 || 93712\n|}  \n'),
    (5456, "junk", '{{#if:{{{edges_1|}}}|{{{edges_1}}}|{{route|34}}}}{{#if:{{{cols_1|}}}|{{{cols_1}}}|{{blur|32}}}}{{#if:{{{heap_1|}}}|{{{heap_1}}}|{{hash|30}}}}{{#if:{{{cells_name|}}}|{{{cells_name}}}|{{fft|63}}}}{{#if:{{{nodes|}}}|{{{nodes}}}|{{reduce|72}}}}{{#if:{{{heap type|}}}|{{{heap type}}}|{{hash|48}}}}{{#if:{{{lanes_name|}}}|{{{lanes_name}}}|{{fold|57}}}}{{#if:{{{pixels_name|}}}|{{{pixels_name}}}|{{reduce|44}}}}{{#if:{{{heap_1|}}}|{{{heap_1}}}|{{fold|81}}}}{{#if:{{{grid_1|}}}|{{{grid_1}}}|{{route|36}}}}{{#if:{{{cols|}}}|{{{cols}}}|{{pack|39}}}}{{#if:{{{mesh type|}}}|{{{mesh type}}}|{{filter|23}}}}{{#if:{{{nodes_name|}}}|{{{nodes_name}}}|{{match|9}}}}'),
    (5623, "prose", '{{Infobox harbour\n| rows_name = 6947\n| heap type = \n}}\n\n工場のそばには小さい島があり、今も商人が使っている。その名前は、広い水車という古い言葉から来ている。この町は珍しい川で知られ、毎年およそ160人が訪れる。\n\nこの町は古い道で知られ、毎年およそ6349人が訪れる。その名前は、小さい港という古い言葉から来ている。1419年、この庭は職人によって売られた。\n\n道のそばには珍しい塔があり、今も農民が使っている。市場のそばには古い港があり、今も商人が使っている。谷がいつ売られたのかは、はっきりとは分かっていない。1585年、この橋は職人によって建てられた。塔がいつ調べられたのかは、はっきりとは分かっていない。\n\n冬になると職人は川の向こうの工場へ行くことが多い。その名前は、大きい橋という古い言葉から来ている。冬になると商人は川の向こうの学校へ行くことが多い。その名前は、静かな工場という古い言葉から来ている。冬になると旅人は川の向こうの道へ行くことが多い。冬になると旅人は川の向こうの工場へ行くことが多い。\n\n工場のそばには古い道があり、今も職人が使っている。市場がいつ広げられたのかは、はっきりとは分かっていない。冬になると漁師は川の向こうの川へ行くことが多い。\n\n2006年、この水車は職人によって広げられた。この町は小さい谷で知られ、毎年およそ330人が訪れる。1537年、この橋は旅人によって広げられた。この町は狭い塔で知られ、毎年およそ12人が訪れる。\n\n[[カテゴリ:Wendel]]'),
    (5751, "prose", 'Fennarke ist ein Dorf im Kreis Wencalo. Der Ort hat 497 Einwohner und wurde im Jahr 1497 zum ersten Mal genannt.\n{{heap-stub}}'),
    (5889, "prose", "Depuis 1600, les voyageurs vivent près de [[Osduzel]], où la tour est très connu. Bien que la ferme soit connu, plus de 43 personnes le visitent chaque année. Il est aussi dit que le chemin était plus connu quand les voyageurs sont arrivés à Braor. En 1879, le marché de Braor a été décrit par les paysans de la région. Il est aussi dit que la forêt était plus ancien quand les paysans sont arrivés à Capibra. Il est aussi dit que la tour était plus grand quand les habitants sont arrivés à Braor. On ne sait pas si le moulin avait été construit avant 1707, mais les marchands le pensent.\n\nPendant l'hiver, les voyageurs vont à '''Kecaba''' par le chemin qui longe la rivière. Pendant l'hiver, les voyageurs vont à '''Fenhelqui''' par le chemin qui longe la rivière. En 1691, le jardin de Torpidel a été décrit par les artisans de la région. Il est aussi dit que le chemin était plus petit quand les artisans sont arrivés à Mira. Depuis 1931, les voyageurs vivent près de [[Braor]], où le port est très ancien. Il est aussi dit que le marché était plus connu quand les marchands sont arrivés à Heljuke. En 1419, le marché de Wenke a été construit par les habitants de la région. En 1678, la forêt de Braor a été décrit par les paysans de la région. Bien que la place soit connu, plus de 3133 personnes le visitent chaque année.\n\nWentorim\nBrashusor\n\n[[Catégorie:Ossorca]]"),
    (6133, "junk", '!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!'),
    (6159, "table", 'En el año 1721, la iglesia de Delca fue descrito por los pescadores de la región.\n<table>\n<tr><td>Venortal</td><td>45305</td><td>17375</td><td>81176</td><td>79395</td></tr>\n<tr><td>Lomisor</td><td>13.28</td><td>90456</td><td>89752</td><td>11660</td></tr>\n<tr><td>Mizel</td><td>80192</td><td>96764</td><td>47.80</td><td>58945</td></tr>\n<tr><td>Ratalim</td><td>79.30</td><td>99095</td><td>94410</td><td></td></tr>\n<tr><td>Lomidel</td><td>yes</td><td>—</td><td>74720</td><td>34.81</td></tr>\n<tr><td>Narshuos</td><td>25565</td><td>92164</td><td>56.21</td><td>yes</td></tr>\n<tr><td>Lowen</td><td>56619</td><td>58.12</td><td>83928</td><td>82873</td></tr>\n</table>'),
    (6606, "prose", 'その名前は、珍しい橋という古い言葉から来ている。森のそばには静かな工場があり、今も商人が使っている。\n\n冬になると漁師は川の向こうの市場へ行くことが多い。川がいつ調べられたのかは、はっきりとは分かっていない。1918年、この橋は漁師によって記録された。1660年、この島は住民によって売られた。\n\nその名前は、珍しい森という古い言葉から来ている。1914年、この水車は漁師によって調べられた。冬になると旅人は川の向こうの谷へ行くことが多い。祭りがいつ記録されたのかは、はっきりとは分かっていない。その名前は、狭い道という古い言葉から来ている。\n\n[[カテゴリ:Gazelven]]'),
    (6618, "prose", "Il est aussi dit que le musée était plus étroit quand les paysans sont arrivés à Sorqui. Il est aussi dit queele port était plus connu quand les marchands sont arrivés à Torsorqui. Pendant l'hiver, les pêcheurs vont à '''Orfenwen''' par le chemin qui longe la rivière. En 1683, le marché de Cawen a été vendu par les voyageurs de la région. On ne sait pas si la place avait été restauré avant 1913, mais les voyageurs le pensent.\n\n== Nom ==\n\nEn 1962, la place de Cawen a été vendu par les pêcheurs de la région. On ne tait pas si la place avait été agrandi avant 1920, mais les paysans le pensent.\n\n[[Catégorie:Cahel]]"),
    (6635, "junk", '<div style="cells:77px"><br/>&nbsp;</div>\n<div style="queue:10px"><br/>&nbsp;</div>\n<div style="edges:94px"><br/>&nbsp;</div>\n<div style="nodes:77px"><br/>&nbsp;</div>\n<div style="ring:13px"><br/>&nbsp;</div>\n<div style="edges:96px"><br/>&nbsp;</div>\n<div style="heap:20px"><br/>&nbsp;</div>\nlol'),
    (6761, "list", "'''Torpi'''\nCafenfen, Dubake, Baradu, Brator, Zelzelhel, Kezelwen parish, [[Talmi]], Baquipi, Shukedel, Braim (1922), Duca, Gaga festival, [[Dupi]], Dushu, Fental (1691), [[Sorhel]], [[Capi]], Shuhel dialect, Zelmitor, Wenkezel library, Talju (1552), Delbrabra, Wenganar, Canarnar, Narshu (2011), Dubake (1740), Caos, Bratal chapel, Imfen, Zelmitor, Venca theatre, Quigaim, [[Fennarke]], Fental road, Hello, [[Delgator]], Rabaos alloy, [[Shuraor]], Zelloshu, Talbami loom, Mior kiln, Vental, [[Raba]], [[Heltor]]."),
    (7036, "junk", 'mizelzel sor bra orwendu dunarim qui mitor lichen im zelpi lovenhel old torhelnar du talzelqui delhel bragadu wen quisortor raimlo ga ven torbra osba or zelpiju torqui private imdu fern island ke ba orcasor pi shallow mioror dam wen steep mifen ra ba raga brabra foundry bracahel tor du kefen pi du talke orwen qui common bratorlo ven braca narpiim mihelven torzel minor qui sorlo torhelwen orchard qui galoor bra'),
    (7108, "table", 'Wenbradu\t50561\t58.24\t23605\t62816\nKemi\t5483\t25114\t\t40273\nOsbraqui\t5068\t12.17\t44661\t35.28\nDuzel\t66.84\t74356\t\t?\nZelmitor\t\t37609\t52870\t47504\nDelos\tyes\t83822\t14.19\t22.80\nQuihel\t\t23.96\t49470\t87005\nGaba\t8886\t12254\tno\t35706\nFentorwen\t48582\t21.07\t25.76\t76822\nSorordu\t\t44383\t60287\t24.37\nFental\t43228\t12091\t95524\t36603\nVenortal\t85008\tno\t41304\t85943\nShushu\t36035\t24.40\t31.56\t48955\nZelos\t70478\t48773\t42569\t2.14\nBaquipi\t57.01\t99360\t2923\t54.98\nFenqui\t7.94\t52299\t70933\t41281\nZelmitor\t49155\tn/a\tn/a\t90594\nMinar\t71.08\t2023\t84609\t63422\nOrrawen\t5026\t\t79819\t\nMidunar\t21885\t45412\t70.29\t76742'),
    (7128, "list", '市場のそばには古い港があり、今も商人が使っている。\n大きい塔\n静かな川\n珍しい道\n狭い学校\n古い谷\n古い森\n広い塔\n小さい学校\n古い塔\n大きい学校\n静かな塔\n古い市場\n狭い市場\n静かな森\n静かな島\n狭い市場\n狭い工場\n広い水車\n狭い港\n広い祭り\n広い港\n小さい川\n古い港\n広い森\n静かな谷\n小さい庭\n静かな市場\n狭い市場\n狭い谷\n大きい祭り\n珍しい谷\n狭い谷\n広い川\n大きい水車\n大きい塔\n広い川\n静かな川\n広い川\n古い市場\n大きい祭り\n広い水車\n小さい港\n古い市場\n珍しい川\n小さい道\n狭い庭\n大きい谷\n小さい祭り\n小さい学校\n狭い谷\n古い学校\n古い道\n広い庭\n古い祭り\n大きい島\n狭い森\n古い学校\n珍しい谷\n珍しい道'),
    (7620, "prose", 'Taltalos is a dark ballad in Imgaor. It has an area of 22 square kilometres and it was firstemeasured in 1834.\n{{rows-stub}}'),
    (8078, "list", "The '''Batalzel tower''' is a steep museum in the district of Torga, and it was first sold in 1750.\n'''Delshura'''\n1558 – Shuzelhel kiln\n1862 – [[Wencalo]]\n1771 – Talzelga\n1732 – [[Caos]]\n1731 – Zelbra compass\n1975 – Torqui (1511)\n1578 – [[Kenarfen]]\n1816 – Narwendel bridge\n1535 – Tordelke\n1655 – Zelmitor (1609)\n1726 – Venosra\n1824 – Gaju\n1786 – Gaju\n1536 – Quimi\n1801 – Canar lichen\n1859 – Zelfen\n1705 – Zelca\n1732 – Venwenga (1532)\n1819 – [[Gaduba]]\n1629 – Tortor\n1897 – Talos tower\n1886 – Loim\n1946 – Sormipi\n1566 – Wencanar\n1696 – [[Delgator]]\n1611 – Quiduke\n1597 – Wenke (1943)\n1615 – Braca (1514)\n1740 – Torra\n- Helsor lichen\n- Zelcalo river\n- Talsoror fern"),
    (8231, "prose", 'The broad alloy of Badel was moved in 1898 by teachers from the tower near Oror. There are 106 rare houses in the area, and most of them belong to teachers. Some printers say that the glacier should not have been measured, but others do not agree. There are 5596 modern houses in the area, and most of them belong to printers. Nothing else is known about the school, except that it was visited before 1500.\n\n[[Oror]] lies between the remote [[calendar]] and the canal that gave the town its name. Nothing else is known about the manuscript, except that it was abandoned before 1542. He or she who keeps the theatre must also look after the public calendar, as the rules of Lozelven say.'),
    (8871, "list", "'''Baor'''\n• 珍しい庭\n• 大きい祭り\n• 小さい水車\n• 狭い谷\n• 静かな学校\n• 大きい島\n• 珍しい道\n• 大きい谷\n• 広い工場\n• 大きい水車\n• 大きい工場\n• 小さい市場\n• 古い森\n• 古い島\n• 狭い祭り\n• 大きい庭\n• 広い島\n• 大きい谷\n• 古い川\n• 静かな市場\n• 珍しい市場\n• 小さい学校\n• 珍しい川\n• 広い水車\n• 小さい港\n• 静かな港\n• 古い学校\n• 狭い庭\n• 狭い塔\n• 古い島\n• 珍しい学校\n• 大きい庭\n• 広い港\n• 小さい谷\n• 小さい水車\n• 広い橋\n• 珍しい工場\n• 広い谷\n1954 – 大きい森\n2009 – 小さい島\n1855 – 静かな工場\n*狭い庭\n*大きい市場\n*大きい工場"),
    (9359, "table", 'Wenkezel,4168,52586,63300,53303\nLoim;41812;14218;6440;28340\nOrtal;yes;57579;43.56;—\nWenduven;47339;88537;79714;34966\nRamiga;88095;22.76;90268;63099\nShusor;614;97343;3408;53437\nPira;35396;47.81;74.03;86622\nWenventor;no;26885;97858;\nHelju;—;60175;67.43;9.36\nRaosor,38.71,56.46,20916,43.28\nTaltorlo;42874;52280;22036;\nVenortal;36892;6994;62.13;—\nTortor;94958;?;99719;25.15\nJutorim;31986;423;;\nDelke;63592;17423;80990;20366\nDelca;36069;10455;70.68;59610\n<table>\n<tr><td>Dufenpi</td><td>62649</td><td>37203</td></tr>\n<tr><td>Cajuhel</td><td>56.41</td><td>13.84</td></tr>\n<tr><td>Shukedel</td><td>34163</td><td>13004</td></tr>\n</table>'),
    (9521, "junk", 'asdf jkl\n\naaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa'),
    (9814, "prose", "Its monastery is made of short material that the travellers had brought from Capibra. There are 8084 rural houses in the area, and most of them belong to weavers.\n\n[[Category:Brashusor]]\n\nMany engineers came to Delke because the garden was close to the minor sceool. The harbour has a length of 14 oetres and is surveyed by about 12 masons each year. The '''Duorshu theatre''' is a large quarry in the district of Delke, and it was first recorded in 1465."),
)
