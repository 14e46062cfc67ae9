"""Word lists for finding personal information: given names, street words, cue words."""

#: Frequent given names by language.
GIVEN_NAMES = {
    "tr": "Abdullah Adem Ahmet Alev Ali Alper Arda Arzu Asiye Aslı Asuman Ayça Aydın Ayhan Aykut Ayla Aylin Aynur Aysel Ayşe Ayşegül Aytaç Aziz Bahar Banu Baran Barış Batuhan Bekir Berk Berkay Berna Beyza Bilal Bilge Birgül Buket Bülent Burak Burcu Burhan Büşra Canan Caner Celal Cem Cemal Cemil Cengiz Ceren Cihan Çağla Çağlar Çiğdem Defne Demet Deniz Derya Dilek Doğan Duygu Ebru Ece Elif Emel Emin Emine Emre Ender Engin Erdal Erdem Eren Erhan Erkan Erol Ersin Esin Esra Evren Eylül Fadime Fahri Faruk Fatih Fatma Fatoş Ferhat Feride Figen Filiz Furkan Gamze Gizem Gökhan Gönül Gül Gülay Gülcan Gülsüm Gülşen Güneş Hakan Hale Halil Halit Haluk Hande Harun Hasan Hatice Hülya Hüseyin İbrahim İdris İlhan İlker İpek İrem İsmail İsmet Kadir Kaan Kamil Kemal Kenan Kerem Koray Kübra Levent Mahmut Makbule Mehmet Melek Melike Meltem Merve Mert Meryem Metin Mine Murat Musa Mustafa Müge Naci Nazan Nazım Nazlı Necla Nermin Nesrin Neşe Nevin Nihal Nihat Nilay Nilgün Nur Nuray Nuri Nurten Oğuz Okan Onur Orhan Osman Oya Ömer Özcan Özge Özgür Özlem Pelin Pınar Ramazan",
    "tr2": "Rabia Recep Reyhan Rıza Sabri Sadık Salih Samet Seda Sedat Sefa Selçuk Selda Selim Selin Selma Semra Serap Serdar Serhat Serkan Serpil Sevda Sevgi Sevil Sevim Sezen Sibel Simge Sinan Sinem Songül Süleyman Şaban Şebnem Şenol Şeyma Şule Şükrü Tahsin Tamer Taner Tarık Tolga Tuba Tuğba Tuncay Turgut Tülay Tülin Ufuk Uğur Ümit Ümran Ünal Veli Veysel Volkan Yağmur Yalçın Yaprak Yasemin Yasin Yaşar Yavuz Yeliz Yıldız Yılmaz Yiğit Yunus Yusuf Yücel Zafer Zehra Zekeriya Zeki Zeynep Züleyha",
    "en": "Aaron Abigail Adam Adrian Alan Albert Alexander Alice Amanda Amber Amelia Amy Andrea Andrew Angela Ann Anna Anne Anthony Arthur Ashley Audrey Austin Barbara Benjamin Bernard Beth Betty Beverly Brandon Brenda Brian Bruce Bryan Carl Carol Caroline Catherine Charles Charlotte Cheryl Chloe Christian Christina Christine Christopher Claire Clara Clive Colin Craig Cynthia Daisy Daniel David Dawn Deborah Denise Dennis Derek Diana Diane Donald Donna Doris Dorothy Douglas Duncan Dylan Edith Edward Eleanor Elizabeth Ella Ellen Emily Emma Eric Ethan Eugene Evelyn Florence Frances Francis Frank Frederick Gabriel Gary Geoffrey George Gerald Gillian Gloria Gordon Grace Graham Gregory Hannah Harold Harriet Harry Hazel Heather Helen Henry Howard Hugh Ian Irene Isaac Isabella Ivy Jack Jacob Jacqueline James Jane Janet Janice Jason Jean Jeffrey Jennifer Jeremy Jessica Joan John Jonathan Jordan Joseph Joshua Joyce Judith Judy Julia Julie Justin Karen Katherine Kathleen Kathryn Keith Kelly Kenneth Kevin Kimberly Kyle Larry Laura Lauren Lawrence Leah Leonard Leslie Lily Linda Lisa Logan Louis Louise Lucas Lucy Lydia",
    "en2": "Malcolm Margaret Maria Marie Marilyn Marion Mark Martha Martin Mary Matilda Matthew Maureen Megan Melissa Michael Michelle Mildred Miles Molly Nancy Natalie Nathan Neil Nicholas Nicola Nicole Nigel Noah Nora Norman Oliver Olivia Oscar Owen Pamela Patricia Patrick Paul Paula Peggy Penelope Peter Philip Phoebe Phyllis Rachel Ralph Randy Raymond Rebecca Richard Robert Robin Roger Ronald Rosemary Roy Ruby Russell Ruth Ryan Samantha Samuel Sandra Sarah Scott Sean Sharon Sheila Shirley Simon Sophia Sophie Stella Stephanie Stephen Steven Stewart Stuart Susan Sylvia Terence Teresa Tessa Theodore Theresa Thomas Timothy Tina Tracy Trevor Tyler Valerie Vanessa Vera Victor Victoria Vincent Violet Virginia Walter Wayne Wendy William Winifred Zachary Zoe",
    "de": "Adelheid Albrecht Alfred Alois Andreas Angelika Anja Anke Anneliese Annette Antje Armin Astrid August Barbara Bärbel Bernd Bernhard Berthold Bettina Birgit Björn Brigitte Carsten Christa Christel Christoph Clemens Dagmar Detlef Dieter Dietmar Dietrich Dirk Dominik Doris Dorothea Eberhard Eckhard Edeltraud Elfriede Elisabeth Elke Erich Erika Ernst Erwin Eva Ferdinand Florian Franz Franziska Friederike Friedrich Fritz Gabriele Georg Gerda Gerhard Gertrud Gisela Greta Gudrun Günter Günther Hannelore Hans Harald Hartmut Hedwig Heidi Heike Heiko Heiner Heinrich Heinz Helga Helmut Herbert Hermann Hilde Hildegard Holger Horst Hubert Ilse Inge Ingeborg Ingrid Irmgard Jakob Jan Jens Joachim Jochen Johann Johanna Johannes Jörg Josef Jürgen Jutta Kai Karin Karl Karla Karsten Käthe Katharina Katrin Klara Klaus Konrad Kurt Lars Leonie Liesel Lieselotte Lothar Ludwig Lukas Lutz Magdalena Manfred Manuela Margarete Markus Marlene Marlies Marta Mathilde Matthias Max Maximilian Michaela Monika Moritz Niklas Norbert Olaf Otto Petra Rainer Ralf Regina Reinhard Reinhold Renate Rolf Rosa Rudolf Rüdiger Sabine Siegfried Sigrid Silke Simone Stefan Stefanie Susanne Sven Thorsten Torsten Traudel Udo Ulf Ulrich Ulrike Ursula Ute Uwe Veronika Viktor Volker Waltraud Werner Wilhelm Wilhelmine Wolfgang",
    "fr": "Adèle Adrien Agathe Agnès Alain Albane Alexandre Alexis Alice Aline Amandine Amélie Anaïs André Anne Antoine Arnaud Aude Audrey Aurélie Baptiste Bastien Béatrice Benoît Bernadette Bertrand Brigitte Bruno Camille Capucine Carole Catherine Cécile Cédric Céline Chantal Charlène Christelle Christophe Claire Claude Claudine Clément Clémence Colette Corinne Cyril Damien Delphine Denis Didier Dominique Édith Édouard Éliane Élise Élodie Éloïse Émile Émilie Emmanuel Éric Estelle Étienne Eugénie Fabien Fabienne Fabrice Florence Florian Francine François Françoise Frédéric Gaëlle Gaspard Geneviève Georges Gérard Ghislaine Gilbert Gilles Gisèle Grégoire Guillaume Guy Hélène Henri Henriette Hervé Hubert Huguette Isabelle Jacques Jean Jeanne Jérôme Joëlle Josette Julien Juliette Justine Laure Laurent Léa Léon Liliane Lionel Loïc Louis Luc Lucie Lucien Ludovic Madeleine Manon Marc Marcel Margaux Margot Marguerite Marie Marion Martine Mathieu Mathilde Maurice Maxime Mélanie Michel Michèle Mireille Monique Muriel Nadège Nathalie Nicolas Noémie Odette Odile Olivier Pascal Pascale Patrice Paulette Philippe Pierre Quentin Raphaël Raymonde Régis Rémi Renaud René Renée Robert Roland Romain Sabrina Sandrine Sébastien Serge Séverine Simone Solange Solène Stéphane Suzanne Sylvain Sylvie Thérèse Thibault Thierry Thomas Valentin Valérie Véronique Vincent Virginie Viviane Xavier Yann Yannick Yves Yvette Yvonne",
    "es": "Adela Adolfo Adriana Agustín Alba Alberto Alejandra Alejandro Alfonso Alfredo Alicia Almudena Álvaro Amalia Amparo Ana Andrés Ángel Ángela Ángeles Antonia Antonio Araceli Arturo Ascensión Asunción Aurora Beatriz Begoña Belén Benito Blanca Carla Carlos Carmen Carolina Catalina Cayetano César Clara Claudia Concepción Consuelo Cristina Cristóbal Daniela Diego Dolores Domingo Eduardo Elena Elvira Emilia Emilio Encarnación Enrique Ernesto Esperanza Esteban Estela Esther Eugenia Eusebio Eva Fabián Federico Felipe Félix Fermín Fernanda Fernando Fidel Francisca Francisco Gabriela Gerardo Gloria Gonzalo Gregorio Guadalupe Guillermo Gustavo Héctor Hugo Ignacio Íñigo Inés Inmaculada Irene Isabel Ismael Iván Jacinto Jaime Javier Jesús Joaquín Jorge José Josefa Josefina Juan Juana Julián Julio Laura Leandro Leonor Leticia Lorena Lorenzo Lourdes Lucas Lucía Luis Luisa Magdalena Manuel Manuela Marcelo Marcos Margarita María Mariana Mariano Marina Mario Marta Martín Mateo Matías Mauricio Mercedes Miguel Milagros Miriam Mónica Montserrat Natalia Nicolás Nieves Noelia Nuria Olga Óscar Pablo Paloma Patricia Paz Pedro Pilar Rafael Ramiro Ramón Raquel Raúl Remedios Ricardo Roberto Rocío Rodrigo Rogelio Rosa Rosalía Rosario Rubén Salvador Sandra Santiago Sara Sergio Silvia Sofía Soledad Susana Teodoro Teresa Tomás Trinidad Valentina Verónica Vicente Víctor Victoria Virginia Ximena Yolanda",
}

#: Words that name a kind of street or district, by language.
STREET_WORDS = {
    "tr": "mahallesi mah mh caddesi cad cd sokağı sokak sok sk bulvarı bulvar blv bul çıkmazı meydanı yolu",
    "en": "street st road rd avenue ave lane ln drive dr court ct boulevard blvd way place pl terrace close crescent square sq parkway row hill mews",
    "de": "straße strasse str gasse weg allee platz ring damm ufer steig pfad",
    "fr": "rue avenue av boulevard bd place pl chemin allée impasse quai cours route passage sentier",
    "es": "calle c avenida av avda paseo plaza pza camino carretera ronda travesía callejón cuesta",
}

#: Words that name a unit in a house, by language.
UNIT_WORDS = "daire d kat no nr num numara apt apartment unit flat suite apartamento piso puerta esc escalera bâtiment bât appt appartement étage wohnung whg stock hinterhaus blok block bis ter"

#: Titles before names.
TITLES = "dr prof doç mr mrs ms miss sir herr frau monsieur madame mme mlle señor señora sr sra don doña sayın bay bayan av müh"

#: Words that make a run of names an organisation, place or project.
ORGANISATIONS = "yazılım şirketi ltd a.ş aş inc corp gmbh ag llc plc sarl sa sl vakfı derneği projesi project projekt projet proyecto arşivi archive archiv archives archivo fonds vadi vadisi müzesi museum musée museo institute enstitüsü institut instituto university üniversitesi universität université universidad köprüsü bridge brücke pont puente dağı mountain gölü lake parkı park software foundation stiftung fondation fundación society team ekibi station istasyonu hospital hastanesi school okulu"
