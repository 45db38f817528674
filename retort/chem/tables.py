"""Published substructure patterns and atom contributions."""

from __future__ import annotations

# Atom types of Ghose, Crippen and Wildman in their order, each with what such an atom adds to
# the logarithm of the partition coefficient and to the molar refractivity (Wildman and Crippen, 1999).
ATOM_TYPES: tuple[tuple[str, float, float], ...] = (
    ("[CH4]", 0.1441, 2.503),
    ("[CH3]C", 0.1441, 2.503),
    ("[CH2](C)C", 0.1441, 2.503),
    ("[CH](C)(C)C", 0, 2.433),
    ("[C](C)(C)(C)C", 0, 2.433),
    ("[CH3][N,O,P,S,F,Cl,Br,I]", -0.2035, 2.753),
    ("[CH2X4]([N,O,P,S,F,Cl,Br,I])[A;!#1]", -0.2035, 2.753),
    ("[CH1X4]([N,O,P,S,F,Cl,Br,I])([A;!#1])[A;!#1]", -0.2051, 2.731),
    ("[CH0X4]([N,O,P,S,F,Cl,Br,I])([A;!#1])([A;!#1])[A;!#1]", -0.2051, 2.731),
    ("[C]=[!C;A;!#1]", -0.2783, 5.007),
    ("[CH2]=C", 0.1551, 3.513),
    ("[CH1](=C)[A;!#1]", 0.1551, 3.513),
    ("[CH0](=C)([A;!#1])[A;!#1]", 0.1551, 3.513),
    ("[C](=C)=C", 0.1551, 3.513),
    ("[CX2]#[A;!#1]", 0.0017, 3.888),
    ("[CH3]c", 0.08452, 2.464),
    ("[CH3]a", -0.1444, 2.412),
    ("[CH2X4]a", -0.0516, 2.488),
    ("[CHX4]a", 0.1193, 2.582),
    ("[CH0X4]a", -0.0967, 2.576),
    ("[cH0]-[A;!C;!N;!O;!S;!F;!Cl;!Br;!I;!#1]", -0.5443, 4.041),
    ("[c][#9]", 0, 3.257),
    ("[c][#17]", 0.245, 3.564),
    ("[c][#35]", 0.198, 3.18),
    ("[c][#53]", 0, 3.104),
    ("[cH]", 0.1581, 3.35),
    ("[c](:a)(:a):a", 0.2955, 4.346),
    ("[c](:a)(:a)-a", 0.2713, 3.904),
    ("[c](:a)(:a)-C", 0.136, 3.509),
    ("[c](:a)(:a)-N", 0.4619, 4.067),
    ("[c](:a)(:a)-O", 0.5437, 3.853),
    ("[c](:a)(:a)-S", 0.1893, 2.673),
    ("[c](:a)(:a)=[C,N,O]", -0.8186, 3.135),
    ("[C](=C)(a)[A;!#1]", 0.264, 4.305),
    ("[C](=C)(c)a", 0.264, 4.305),
    ("[CH1](=C)a", 0.264, 4.305),
    ("[C]=c", 0.264, 4.305),
    ("[CX4][A;!C;!N;!O;!P;!S;!F;!Cl;!Br;!I;!#1]", 0.2148, 2.693),
    ("[#6]", 0.08129, 3.243),
    ("[#1][#6,#1]", 0.123, 1.057),
    ("[#1]O[CX4,c]", -0.2677, 1.395),
    ("[#1]O[!C;!N;!O;!S]", -0.2677, 1.395),
    ("[#1][!C;!N;!O]", -0.2677, 1.395),
    ("[#1][#7]", 0.2142, 0.9627),
    ("[#1]O[#7]", 0.2142, 0.9627),
    ("[#1]OC=[#6,#7,O,S]", 0.298, 1.805),
    ("[#1]O[O,S]", 0.298, 1.805),
    ("[#1]", 0.1125, 1.112),
    ("[NH2+0][A;!#1]", -1.019, 2.262),
    ("[NH+0]([A;!#1])[A;!#1]", -0.7096, 2.173),
    ("[NH2+0]a", -1.027, 2.827),
    ("[NH1+0]([!#1;A,a])a", -0.5188, 3),
    ("[NH+0]=[!#1;A,a]", 0.08387, 1.757),
    ("[N+0](=[!#1;A,a])[!#1;A,a]", 0.1836, 2.428),
    ("[N+0]([A;!#1])([A;!#1])[A;!#1]", -0.3187, 1.839),
    ("[N+0](a)([!#1;A,a])[A;!#1]", -0.4458, 2.819),
    ("[N+0](a)(a)a", -0.4458, 2.819),
    ("[N+0]#[A;!#1]", 0.01508, 1.725),
    ("[NH3,NH2,NH;+,+2,+3]", -1.95, 0),
    ("[n+0]", -0.3239, 2.202),
    ("[n;+,+2,+3]", -1.119, 0),
    ("[NH0;+,+2,+3]([A;!#1])([A;!#1])([A;!#1])[A;!#1]", -0.3396, 0.2604),
    ("[NH0;+,+2,+3](=[A;!#1])([A;!#1])[!#1;A,a]", -0.3396, 0.2604),
    ("[NH0;+,+2,+3](=[#6])=[#7]", -0.3396, 0.2604),
    ("[N;+,+2,+3]#[A;!#1]", 0.2887, 3.359),
    ("[N;-,-2,-3]", 0.2887, 3.359),
    ("[N;+,+2,+3](=[N;-,-2,-3])=N", 0.2887, 3.359),
    ("[#7]", -0.4806, 2.134),
    ("[o]", 0.1552, 1.08),
    ("[OH,OH2]", -0.2893, 0.8238),
    ("[O]([A;!#1])[A;!#1]", -0.0684, 1.085),
    ("[O](a)[!#1;A,a]", -0.4195, 1.182),
    ("[O]=[#7,#8]", 0.0335, 3.367),
    ("[OX1;-,-2,-3][#7]", 0.0335, 3.367),
    ("[OX1;-,-2,-2][#16]", -0.3339, 0.7774),
    ("[O;-0]=[#16;-0]", -0.3339, 0.7774),
    ("[O-]C(=O)", -1.326, 0),
    ("[OX1;-,-2,-3][!#1;!N;!S]", -1.189, 0),
    ("[O]=c", 0.1788, 3.135),
    ("[O]=[CH]C", -0.1526, 0),
    ("[O]=C(C)([A;!#1])", -0.1526, 0),
    ("[O]=[CH][N,O]", -0.1526, 0),
    ("[O]=[CH2]", -0.1526, 0),
    ("[O]=[CX2]=O", -0.1526, 0),
    ("[O]=[CH]c", 0.1129, 0.2215),
    ("[O]=C([C,c])[a;!#1]", 0.1129, 0.2215),
    ("[O]=C(c)[A;!#1]", 0.1129, 0.2215),
    ("[O]=C([!#1;!#6])[!#1;!#6]", 0.4833, 0.389),
    ("[#8]", -0.1188, 0.6865),
    ("[#9-0]", 0.4202, 1.108),
    ("[#17-0]", 0.6895, 5.853),
    ("[#35-0]", 0.8456, 8.927),
    ("[#53-0]", 0.8857, 14.02),
    ("[#9,#17,#35,#53;-]", -2.996, 0),
    ("[#53;+,+2,+3]", -2.996, 0),
    ("[+;#3,#11,#19,#37,#55]", -2.996, 0),
    ("[#15]", 0.8612, 6.92),
    ("[S;-,-2,-3,-4,+1,+2,+3,+5,+6]", -0.0024, 7.365),
    ("[S-0]=[N,O,P,S]", -0.0024, 7.365),
    ("[S;A]", 0.6482, 7.591),
    ("[s;a]", 0.6237, 6.691),
    ("[#3,#11,#19,#37,#55]", -0.3808, 5.754),
    ("[#4,#12,#20,#38,#56]", -0.3808, 5.754),
    ("[#5,#13,#31,#49,#81]", -0.3808, 5.754),
    ("[#14,#32,#50,#82]", -0.3808, 5.754),
    ("[#33,#51,#83]", -0.3808, 5.754),
    ("[#34,#52,#84]", -0.3808, 5.754),
    ("[#21,#22,#23,#24,#25,#26,#27,#28,#29,#30]", -0.0025, 0),
    ("[#39,#40,#41,#42,#43,#44,#45,#46,#47,#48]", -0.0025, 0),
    ("[#72,#73,#74,#75,#76,#77,#78,#79,#80]", -0.0025, 0),
)

# Functional groups whose charge is counted.
FUNCTIONAL_GROUPS: tuple[str, ...] = (
    "[O&X2:2][C&X4&!$(CO~[!#6]):1][O&X2:3]",
    "[C&X3:1](=[O&X1:2])[F,Cl,Br,I:3]",
    "[C:1][O&H1&!$(OC~[!#1&!#6]):2]",
    "[C&X3&H1,H2:1]=[O&X1&!$(O=C~[!#1&!#6]):2]",
    "[C&H1:1]=[N:2][O&H1:3]",
    "[A:1]",
    "[C&X4:1][N&X3&!$(NC~[!#1&!#6&!F&!Cl&!Br&!I])&!$(N~[!#1&!#6])&!$(Nc):2]",
    "[!#1&!#6&A:1]",
    "[#3,#11,#19,#37,#55,#87:1]",
    "[#4,#12,#20,#38,#56,#88:1]",
    "[C:1]=[C:1]",
    "[C&X2:1](=[C:2])=[C:2]",
    "[C&H2:3]=[C&H1:2][C&H2:1]",
    "[C:1][O&-&!$(OC~[!#1&!#6]):2]",
    "[C:1][O&X2&H0&!$(OC~[!#1&!#6]):2]",
    "[C&X2:1]#[C&X2:1]",
    "[C&X4:1][F,Cl,Br,I;!$([F,Cl,Br,I]C~[!#1&!#6]):2]",
    "[N&X3:2][C&X3:1]=[O&X1:3]",
    "[N&X3:3][C:1]=[N&X2:2]",
    "[#6:1][N&X3&!$(NC~[!#1&!#6&!F&!Cl&!Br&!I])&!$(N~[!#1&!#6]):2]",
    "[#6:1][N&X4&+:2]",
    "[C&X3:1](=[O&X1:2])[O&X2:3][C&X3:1]=[O&X1:2]",
    "[c:1][N&X3&!$(NC~[!#1&!#6])&!$(N~[!#1&!#6]):2]",
    "[*:1]",
    "[a:1]",
    "[!#1&!#6&a:1]",
    "[c&X3:1][F,Cl,Br,I:2]",
    "[C:1]1[C:1][N:2]1",
    "[#6:2]/[N&X2:1]=[N&X2:1]/[#6:2]",
    "[N&X2:2]=[N&X2:3][S&X4:1](=[O:5])=[O:4]",
    "[#6:1][$([N&X2:2]=[N&X3&+:3]([O&-:4])[#6:5]),$([N&X2:2]=[N&X3&+0:3](=[O:4])[#6:5])]",
    "[C&H2]-c1[c&H1][c&H1][c&H1][c&H1][c&H1]1",
    "[Br&-:1]",
    "[N&X3,N&X4&+:2][C&X3:1](=[O&X1:3])[O&X2,O&X1&-:4]",
    "[C:1](=[O&X1:2])([O:3][#6:4])[O:3][#6:4]",
    "[C&X3:1]=[O&X1:2]",
    "[C&X3:1](=[O:2])[O&X2&H1:3]",
    "[C&X3:1](=[O:2])[O&-:3]",
    "[R0:1]",
    "[Cl&-:1]",
    "[#1]OC([#1])(C(=O)N([#1])C([#1])([#1])C([#1])([#1])C(=O)N([#1])C([#1])([#1])[C:2]([#1])([#1])[S:1])C(C([#1])([#1])[#1])(C([#1])([#1])[#1])C([#1])([#1])OP(=O)(O[#1])OP(=O)(O[#1])OC([#1])([#1])C1([#1])OC([#1])(n2c([#1])nc3c(nc([#1])nc23)N([#1])[#1])C([#1])(O[#1])C1([#1])OP(=O)(O[#1])O[#1]",
    "[N&X3:3][C&X2:1]#[N&X1:2]",
    "[N&X3:3][C&X2:1]#[N&X1:2]",
    "[$([#6:1]=[N&+:2]=[N&-:3]),$([#6&-:1]-[N&+:2]#[N:3])]",
    "[#6&+0:1]-[N&+:2]#[N:3]",
    "[#6:1][S&X2&H0:2][S&X2&H0:2][#6:1]",
    "[N&X3&!$(NC~[!#1&!#6]):3][C&X3:1]=[C&X3:2]",
    "[O&X2&H1:3][C&X3:2]=[C:1]",
    "[C:1]1[C:1][O:2]1",
    "[#6:5][O&X2:2][C&X3:1](=[O:3])[#6:4]",
    "[O&D2&!$(OC~[!#1&!#6]):2]([#6:1])[#6:1]",
    "[F&-:1]",
    "[F,Cl,Br,I:1]",
    "[C:4][O&X2:3][C&H1:1]([#6:2])[O&H1&X2:5]",
    "[!#1&!#6:1]",
    "[#6:1][N&X3:2][N&X3:3]",
    "[N&X3:3][N&X2:2]=[C:1]",
    "[#6:1][O&H1&!$(O[#6]~[!#1&!#6]):2]",
    "[N&X2:2][O&H1:3]",
    "[C&X3:1](=[O&X1:3])[N&X3:2][C&X3:1]=[O&X1:3]",
    "[C&X3:1]=[N&X2&!$(N~C~[!#1&!#6]):3][#6,#1:2]",
    "[N&X3&+:2]=[C&X3:1]",
    "[I&-:1]",
    "[N&X2:2]=[C:1]=[O&X1:3]",
    "[N&+:2]#[C&-:1]",
    "[N&+:2]#[C&-:1]",
    "[N&X2:2]=[C:1]=[S&X1:3]",
    "[O&X2:2][C&H0&X4&!$(CO~[!#6]):1][O&X2:3]",
    "[C:1]=[C:2]=[O&X1:3]",
    "[#6:2][C&X3:1](=[O:3])[#6:2]",
    "[C:1](=[N:2][O&H1:3])([#6:4])[#6:4]",
    "[!#1&!#2&!#5&!#6&!#7&!#8&!#9&!#10&!#14&!#15&!#16&!#17&!#18&!#32&!#33&!#34&!#35&!#36&!#51&!#52&!#53&!#54&!#85&!#86:1]",
    "[B,#14,#32,#33,#51,#52,#85:1]",
    "[#7:1][O&X1&!$(O[#7]~[!#1&!#6]):2]",
    "[N&X1:2]#[C&X2:1]",
    "[#6:1][$([N&X3:2](=[O:3])=[O:3]),$([N&X3&+:1](=[O:3])[O&-:3])]",
    "[N&X2:1]=[O&X1:2]",
    "[#1,#2,#6,#7,#8,F,#10,#15,#16,Cl,#18,#34,Br,#36,I,#54,#86:1]",
    "[C:1]=[N:2][O&H1:3]",
    "[O&X2,O&X1&-][O&X2,O&X1&-]",
    "[c:1][O&X2&H1:2]",
    "[c:1][O&X1&-:2]",
    "[c:1][O&X2&H0&!$(OC~[!#1&!#6]):2]",
    "[c&H1]1[c&H1][c&H1][c&H1][c&H1]c1",
    "[PX3;$([H3]),$([H2][#6]),$([H1]([#6])[#6]),$([H0]([#6])([#6])[#6])]",
    "[N&X3&H2:2][C&X3:1]=[O&X1:3]",
    "[#6:1][#7&A&H2&X3&!$(NC~[!#1&!#6&!F&!Cl&!Br&!I])&!$(N~[!#1&!#6]):2]",
    "[H1,H2,H3,H4&+:1]",
    "[#6&X4:1][N&X4&H0&!$(NC~[!#1&!#6]):2]",
    "[R:1]",
    "[N&X3&H1:2][C&X3:1]=[O&X1:3]",
    "[#6:1][N&X3&H1&!$(NC~[!#1&!#6&!F&!Cl&!Br&!I])&!$(N~[!#1&!#6]):2]",
    "[#6:1][S&X2&H0&!$(SC~[!#1&!#6]):2][#6:1]",
    "[#6:1][$([S&X4:2]([N&X3:3])(=[O&X1:4])=[O&X1:4]),$([S&X4&+2:2]([N&X3:3])([O&X1&-:4])[O&X1&-:4])]",
    "[$([S&X4:2](=[O&X1:3])(=[O&X1:3])([#6:1])[#6:1]),$([S&X4&+2:2]([O&X1&-:3])([O&X1&-:3])([#6:1])[#6:1])]",
    "[#6:1][$([S&X4:2](=[O&X1:4])(=[O&X1:4])[O&X2&H1,O&X1&H0&-:3]),$([S&X4&+2:2]([O&X1&-:4])([O&X1&-:4])[O&X2&H1,O&X1&H0&-:3])]",
    "[$([SX3](=[OX1])([#6])[#6]),$([SX3+]([OX1-])([#6])[#6])]",
    "[N&X3&H0:2][C&X3:1]=[O&X1:3]",
    "[#6:1][N&X3&H0&!$(NC~[!#1&!#6&!F&!Cl&!Br&!I]):2]",
    "[#6:1][N&X3&H0&!$(NC~[!#1&!#6&!F&!Cl&!Br&!I]):2]",
    "[N&X3:2][C&X3:1]=[S&X1:3]",
    "[C&X3:1](=[S:2])[S&X2&H1:3]",
    "[C&X3:1](=[S:2])[S&-:3]",
    "[#6:5][S&X2:2][C&X3:1](=[O:3])[#6:4]",
    "[#6:1][S&H1&!$(S[#6]~[!#1&!#6]):2]",
    "[N&X3:2][C&X3:1](=[S&X1:3])[N&X3:2]",
    "[N&X3:2][C&X3:1](=[O&X1:3])[N&X3:2]",
    "[C&X3&H2:1]=[C&X3&H1:1]",
)

# Patterns of structural keys that are counted; None stands for those counted otherwise.
KEYS: tuple[str | None, ...] = (
    None,
    "[#7]",
    "[#8]",
    "[#9]",
    "[#14]",
    "[#15]",
    "[#16]",
    "[#17]",
    "[#35]",
    "[#53]",
    "a",
    "[F,Cl,Br,I]",
    "[!+0]",
    "[!#6;!#1;!H0]",
    "[!#1;!#6;!#7;!#8;!#9;!#14;!#15;!#16;!#17;!#35;!#53]",
    "[Li,Na,K,Rb,Cs,Fr]",
    "[Cu,Zn,Ag,Cd,Au,Hg]",
    "[Be,Mg,Ca,Sr,Ba,Ra]",
    "[#5,#13,#31,#49,#81]",
    "[Sc,Ti,Y,Zr,Hf]",
    "[#32,#33,#34,#50,#51,#52,#82,#83,#84]",
    "[V,Cr,Mn,Nb,Mo,Tc,Ta,W,Re]",
    "[Fe,Co,Ni,Ru,Rh,Pd,Os,Ir,Pt]",
    "[Ac,Th,Pa,U,Np,Pu,Am,Cm,Bk,Cf,Es,Fm,Md,No,Lr]",
    "[La,Ce,Pr,Nd,Pm,Sm,Eu,Gd,Tb,Dy,Ho,Er,Tm,Yb,Lu]",
    "[R]",
    None,
    "[!#6;R]",
    "[!C;!c;R]",
    "[#16R]",
    "[#8R]",
    "[#7;R]",
    "*1~*~*~1",
    "*1~*~*~*~1",
    "*1~*~*~*~*~1",
    "*1~*~*~*~*~*~1",
    "*1~*~*~*~*~*~*~1",
    None,
    "[#16]-[#16]",
    "[#7]-[#8]",
    "[#7]~[#16]",
    "[#16]-[#8]",
    "[#7]~[#7]",
    "[#16]=[#8]",
    "[#7]=[#8]",
    "c:n",
    "[!#6;!#1]~[#16]",
    "[#7]~[#8]",
    "[#16]=*",
    "[#6]=[#7]",
    "[NH2]",
    "[!#6;!#1]~[#7]",
    "[#6]=[#6]",
    "[!#6;!#1]~[#8]",
    "[!#6;!#1]~[F,Cl,Br,I]",
    "[#7]=*",
    "[!#6;!#1]~[!#6;!#1]",
    "[#8]=*",
    "[O;!H0]",
    "[CH3]",
    "[C;H3,H4]",
    "[#7;!H0]",
    "[#6]=[#8]",
    "[#6]-[#8]",
    "[#6]-[#7]",
    "[C;H3,H4]",
    "[#6]#[#6]",
    "[#6]#[#7]",
    "[#6]~[#16]~[#8]",
    "[#6]~[#16]~[#7]",
    "[CH2]=*",
    "[#6]=[#6]~[#7]",
    "[#16]~*~[#7]",
    "[#8]~[#16]~[#8]",
    "[!#6;!#1]~[#16]~[!#6;!#1]",
    "[#16]!:*:*",
    "[!#6;!#1]~[!#6;!#1;!H0]",
    "[!#6;!#1]~[#7]~[!#6;!#1]",
    "[#7]~*~[#7]",
    "[#7]~[#6]~[#8]",
    "[#7]~*~[#8]",
    "[#8]~[#6]~[#8]",
    "*!@[#8]!@*",
    "*@*!@*@*",
    "*@*!@[#16]",
    "[F,Cl,Br,I]!@*@*",
    "*@*!@[#8]",
    "*@*!@[#7]",
    "[#7]!:*:*",
    "*@*!@[#8]",
    "[#7]~[#6](~[#8])~[#7]",
    "[!#6;!#1]1~*~*~*~1",
    "[#8]~[#7](~[#6])~[#6]",
    "[#8]~[#6](~[#8])~[#8]",
    "[!#6;!#1]1~*~*~1",
    "[#6]=[#6](~[!#6;!#1])~[!#6;!#1]",
    "[#7]~[#6](~[#8])~[#8]",
    "[#7]~[#6](~[#7])~[#7]",
    "[#6]=;@[#6](@*)@*",
    "[!#6;!#1]~[CH2]~[!#6;!#1]",
    "[#6]~[!#6;!#1](~[#6])(~[#6])~*",
    "[#8]~[#16](~[#8])~[#8]",
    "[!#6;!#1;!H0]~*~[!#6;!#1;!H0]",
    "[#8]~[!#6;!#1](~[#8])(~[#8])",
    "[#6]=[#6](~[#6])~[#6]",
    "[!#6;!#1;!H0]~*~*~*~[!#6;!#1;!H0]",
    "[!#6;!#1;!H0]~*~*~[!#6;!#1;!H0]",
    "[#8]~[#7](~[#8])~[#6]",
    "*~[#16](~*)~*",
    "[#6]~[#6](~[#6])(~[#6])~*",
    "[!#6;!#1;!H0]~[!#6;!#1;!H0]",
    "[#8]~*~*~[#8]",
    "[CH3]~*~[CH3]",
    "*!@[#7]@*",
    "[#6]=[#6](~*)~*",
    "[#7]~*~*~[#7]",
    "[#7]~*~*~*~[#7]",
    "[#16]~*(~*)~*",
    "*~[CH2]~[!#6;!#1;!H0]",
    "[!#6;!#1]1~*~*~*~*~1",
    "[#6]~[#7](~[#6])~[#6]",
    "[C;H2,H3][!#6;!#1][C;H2,H3]",
    "[#8]~*~*~*~[#8]",
    "[$([!#6;!#1;!H0]~*~*~[CH2]~*),$([!#6;!#1;!H0;R]1@[R]@[R]@[CH2;R]1),$([!#6;!#1;!H0]~[R]1@[R]@[CH2;R]1)]",
    "[$([!#6;!#1;!H0]~*~*~*~[CH2]~*),$([!#6;!#1;!H0;R]1@[R]@[R]@[R]@[CH2;R]1),$([!#6;!#1;!H0]~[R]1@[R]@[R]@[CH2;R]1),$([!#6;!#1;!H0]~*~[R]1@[R]@[CH2;R]1)]",
    "[#8]~[#6](~[#7])~[#6]",
    "[!#6;!#1]~[CH3]",
    "[#7]~*~*~[#8]",
    "[#7]~*~*~*~[#8]",
    "[!#6;!#1]1~*~*~*~*~*~1",
    "*~[CH2]~[#7]",
    "[!#6;!#1;!H0]~*~[CH2]~*",
    "*@*(@*)@*",
    "[!#6;!#1]~*(~[!#6;!#1])~[!#6;!#1]",
    "[F,Cl,Br,I]~*(~*)~*",
    "[CH3]~*~*~*~[CH2]~*",
    "*~[CH2]~[#8]",
    "[#7]~*~[CH2]~*",
    "*~*(~*)(~*)~*",
    "[#8]!:*:*",
    "[CH3]~[CH2]~*",
    "[CH3]~*~[CH2]~*",
    "[$([CH3]~*~*~[CH2]~*),$([CH3]~*1~*~[CH2]1)]",
    "[$(*~[CH2]~[CH2]~*),$(*1~[CH2]~[CH2]1)]",
    "*~[#7](~*)~*",
    "[$(*~[CH2]~*~*~*~[CH2]~*),$([R]1@[CH2;R]@[R]@[R]@[R]@[CH2;R]1),$(*~[CH2]~[R]1@[R]@[R]@[CH2;R]1),$(*~[CH2]~*~[R]1@[R]@[CH2;R]1)]",
    "[$(*~[CH2]~*~*~[CH2]~*),$([R]1@[CH2]@[R]@[R]@[CH2;R]1),$(*~[CH2]~[R]1@[R]@[CH2;R]1)]",
    "[#8]~*~[CH2]~*",
    "[!#6;!#1]~[CH2]~*",
    "*!:*:*!:*",
    "[$(*~[CH2]~[CH2]~*),$([R]1@[CH2;R]@[CH2;R]1)]",
    "*~[!#6;!#1](~*)~*",
    "*!@*@*!@*",
    "[#8]~[#6](~[#6])~[#6]",
    "[!#6;!#1]~[CH2]~*",
    "*!@[CH2]!@*",
    "[#7]~*(~*)~*",
)

# Published functional groups by name, counted as a fingerprint.
GROUPS: tuple[tuple[str, str], ...] = (
    ("C=O", "[CX3]=[OX1]"), ("C=O but no acid", "[C!$(C-[OH])]=O"), ("aliphatic hydroxyl", "[C!$(C=O)]-[OH]"), ("aromatic hydroxyl", "c[OH1]"), ("methoxy", "[OX2](-[#6])-[CH3]"), ("oxime", "[CX3]=[NX2]-[OX2]"), ("ester", "[#6][CX3](=O)[OX2H0][#6]"),
    ("aliphatic acid", "C-C(=O)[O;H1,-]"), ("aromatic acid", "c-C(=O)[O;H1,-]"), ("acid", "[#6]C(=O)[O;H,-1]"), ("acid or carboxylate", "[CX3](=O)[OX1H0-,OX2H1]"), ("ketone", "[#6][CX3](=O)[#6]"), ("ether", "[OD2]([#6])[#6]"), ("phenol", "[OX2H]-c1ccccc1"), ("aldehyde", "[CX3H1](=O)[#6]"),
    ("quaternary nitrogen", "[$([NX4+]),$([NX4]=*)]"), ("primary amine", "[NH2,nH2]"), ("secondary amine", "[NH1,nH1]"), ("tertiary amine", "[NH0,nH0]"), ("aromatic nitrogen", "n"), ("aromatic NH", "[nH]"), ("aniline", "c-[NX3;!$(N=*)]"), ("imine", "[Nv3](=C)-[#6]"), ("nitrile", "[NX1]#[CX2]"),
    ("hydrazine", "[NX3]-[NX3]"), ("hydrazone", "C=N-[NX3]"), ("nitroso", "[N!$(N-O)]=O"), ("hydroxylamine", "[N!$(N=O)](-O)-C"), ("nitro", "[$([NX3](=O)=O),$([NX3+](=O)[O-])][!#8]"), ("azo", "[#6]-N=N-[#6]"), ("diazo", "[N+]#N"), ("azide", "[$(*-[NX2-]-[NX2+]#[NX1]),$(*-[NX2]=[NX2+]=[NX1-])]"),
    ("amide", "C(=O)-N"), ("primary amide", "C(=O)-[NH2]"), ("amidine", "C(=N)(-N)-[!#7]"), ("guanidine", "C(=N)(N)N"), ("imide", "N(-C(=O))-C=O"), ("isocyanate", "N=C=O"), ("isothiocyanate", "N=C=S"), ("thiocyanate", "S-C#N"), ("halogen", "[#9,#17,#35,#53]"), ("alkyl halide", "[CX4]-[Cl,Br,I,F]"),
    ("sulfide", "[SX2](-[#6])-C"), ("thiol", "[SH]"), ("thiocarbonyl", "C=[SX1]"), ("sulfone", "S(=,-[OX1;+0,-1])(=,-[OX1;+0,-1])(-[#6])-[#6]"), ("sulfonamide", "N-S(=,-[OX1;+0,-1])(=,-[OX1;+0,-1])-[#6]"), ("primary sulfonamide", "[NH2]-S(=,-[OX1;+0,-1])(=,-[OX1;+0,-1])-[#6]"),
    ("barbiturate", "C1C(=O)NC(=O)NC1=O"), ("urea", "C(=O)(-N)-N"), ("terminal acetylene", "C#[CH]"), ("imidazole", "n1cncc1"), ("furan", "o1cccc1"), ("thiophene", "s1cccc1"), ("thiazole", "c1scnc1"), ("oxazole", "c1ocnc1"), ("pyridine", "n1ccccc1"), ("piperidine", "N1CCCCC1"), ("piperazine", "N1CCNCC1"),
    ("morpholine", "O1CCNCC1"), ("beta lactam", "N1C(=O)CC1"), ("lactone", "[C&R1](=O)[O&R1][C&R1]"), ("tetrazole", "c1nnnn1"), ("epoxide", "O1CC1"), ("unbranched alkane", "[R0;D2][R0;D2][R0;D2][R0;D2]"), ("bicyclic", "[R2][R2]"), ("benzene", "c1ccccc1"), ("alkyl carbamate", "C[NH1]C(=O)OC"),
)

# Published reactive groups that screening sets leave out, by name.
REACTIVE: tuple[tuple[str, str], ...] = (
    ("reactive alkyl halide", "[Br,Cl,I][CX4;CH,CH2]"), ("acid halide", "[S,C](=[O,S])[F,Br,Cl,I]"), ("carbazide", "O=CN=[N+]=[N-]"), ("sulphate ester", "COS(=O)O[C,c]"), ("sulphonate", "COS(=O)(=O)[C,c]"), ("acid anhydride", "C(=O)OC(=O)"), ("peroxide", "OO"),
    ("pentafluorophenyl ester", "C(=O)Oc1c(F)c(F)c(F)c(F)c1(F)"), ("paranitrophenyl ester", "C(=O)Oc1ccc(N(=O)=O)cc1"), ("benzotriazole ester", "C(=O)Onnn"), ("isocyanate or isothiocyanate", "N=C=[S,O]"), ("triflate", "OS(=O)(=O)C(F)(F)F"), ("thionating agent", "P(=S)(S)S"),
    ("phosphoramide", "NP(=O)(N)N"), ("aromatic azide", "cN=[N+]=[N-]"), ("beta carbonyl quaternary nitrogen", "C(=O)C[N+,n+]"), ("acylhydrazide", "[N;R0][N;R0]C(=O)"), ("quaternary carbon, chlorine, iodine, phosphorus or sulphur", "[C+,Cl+,I+,P+,S+]"), ("phosphorane", "C=P"),
    ("chloramidine", "[Cl]C([C&R0])=N"), ("nitroso", "[N&D2](=O)"), ("phosphorus or sulphur halide", "[P,S][Cl,Br,F,I]"), ("carbodiimide", "N=C=N"), ("isonitrile", "[N+]#[C-]"), ("triacyloxime", "C(=O)N(C(=O))OC(=O)"), ("cyanohydrin", "N#CC[OH]"), ("acyl cyanide", "N#CC(=O)"),
    ("sulfonyl cyanide", "S(=O)(=O)C#N"), ("cyanophosphonate", "P(OCC)(OCC)(=O)C#N"), ("azocyanamide", "[N;R0]=[N;R0]C#N"), ("azoalkanal", "[N;R0]=[N;R0]CC=O"), ("disulphide", "SS"), ("thiol", "[SH]"), ("epoxide, thioepoxide or aziridine", "C1[O,S,N]C1"), ("thiocyanate", "SC#N"), ("long methylene chain", "[CD2;R0][CD2;R0][CD2;R0][CD2;R0][CD2;R0][CD2;R0][CD2;R0]"),
)
