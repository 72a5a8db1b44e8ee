"""Constant tables of residues and germlines."""

from __future__ import annotations

# Residue -> hydrophobicity, charge at pH 7.4, molecular weight, volume, polarity, flexibility.
RESIDUES = {
    "A": (1.8, 0.0, 89.09, 88.6, 0.0, 0.360),
    "R": (-4.5, 1.0, 174.20, 173.4, 1.0, 0.530),
    "N": (-3.5, 0.0, 132.12, 114.1, 1.0, 0.460),
    "D": (-3.5, -1.0, 133.10, 111.1, 1.0, 0.510),
    "C": (2.5, 0.0, 121.15, 108.5, 0.0, 0.350),
    "E": (-3.5, -1.0, 147.13, 138.4, 1.0, 0.500),
    "Q": (-3.5, 0.0, 146.15, 143.8, 1.0, 0.490),
    "G": (-0.4, 0.0, 75.03, 60.1, 0.0, 0.540),
    "H": (-3.2, 0.1, 155.16, 153.2, 1.0, 0.320),
    "I": (4.5, 0.0, 131.17, 166.7, 0.0, 0.460),
    "L": (3.8, 0.0, 131.17, 166.7, 0.0, 0.400),
    "K": (-3.9, 1.0, 146.19, 168.6, 1.0, 0.535),
    "M": (1.9, 0.0, 149.21, 162.9, 0.0, 0.410),
    "F": (2.8, 0.0, 165.19, 189.9, 0.0, 0.310),
    "P": (-1.6, 0.0, 115.13, 112.7, 0.0, 0.510),
    "S": (-0.8, 0.0, 105.09, 89.0, 1.0, 0.510),
    "T": (-0.7, 0.0, 119.12, 116.1, 1.0, 0.440),
    "W": (-0.9, 0.0, 204.23, 227.8, 0.0, 0.310),
    "Y": (-1.3, 0.0, 181.19, 193.6, 1.0, 0.420),
    "V": (4.2, 0.0, 117.15, 140.0, 0.0, 0.390),
}

# Human germline sequences, heavy chain.
HEAVY_GERMLINES = {
    "IGHV1-2*02": "QVQLVQSGAEVKKPGASVKVSCKASGYTFTGYYMHWVRQAPGQGLEWMGWINPNSGGTNYAQKFQGRVTMTRDTSISTAYMELSRLRSDDTAVYYCAR",
    "IGHV1-3*01": "QVQLVQSGAEVKKPGASVKVSCKASGYTFTSYAMHWVRQAPGQRLEWMGWINAGNGNTKYSQKFQGRVTITRDTSASTAYMELSSLRSEDTAVYYCAR",
    "IGHV1-18*01": "QVQLVQSGAEVKKPGASVKVSCKASGYTFTSYDINWVRQAPGQGLEWMGWMNPNSGNTGYAQKFQGRVTMTRNTSISTAYMELSSLRSEDTAVYYCAR",
    "IGHV1-46*01": "QVQLVQSGAEVKKPGASVKVSCKASGYTFTGYYMHWVRQAPGQGLEWMGWINPNSGGTNYAQKFQGRVTMTRDTSISTAYMELSRLRSDDTAVYYCAR",
    "IGHV1-69*01": "QVQLVQSGAEVKKPGASVKVSCKASGYTFTGYYMHWVRQAPGQGLEWMGWINPNSGGTNYAQKFQGRVTMTRDTSISTAYMELSRLRSDDTAVYYCAR",
    "IGHV2-5*02": "QITLKESGPTLVKPTQTLTLTCTFSGFSLSTSGVGVGWIRQPPGKALEWLALIYWDDDKRYSPSLKSRLTITKDTSKNQVVLTMTNMDPVDTATYYCAHR",
    "IGHV3-7*01": "EVQLVESGGGLVQPGGSLRLSCAASGFTFSSYWMSWVRQAPGKGLEWVANIKQDGSEKYYVDSVKGRFTISRDNAKNSLYLQMNSLRAEDTAVYYCAR",
    "IGHV3-11*01": "EVQLVESGGGLVQPGGSLRLSCAASGFTFSSYWMHWVRQAPGKGLEWVSRINSDGSSTSYADSVKGRFTISRDNAKNTLYLQMNSLRAEDTAVYYCAK",
    "IGHV3-15*01": "EVQLVESGGGLVQPGGSLRLSCAASGFTFSSYAMSWVRQAPGKGLEWVSAISGSGGSTYYADSVKGRFTISRDNSKNTLYLQMNSLRAEDTAVYYCAR",
    "IGHV3-21*01": "EVQLVESGGGLVKPGGSLRLSCAASGFTFSSYSMNWVRQAPGKGLEWVSSISSSSSYIYYADSVKGRFTISRDNAKNSLYLQMNSLRAEDTAVYYCAR",
    "IGHV3-23*01": "EVQLLESGGGLVQPGGSLRLSCAASGFTFSSYAMSWVRQAPGKGLEWVSAISGSGGSTYYADSVKGRFTISRDNSKNTLYLQMNSLRAEDTAVYYCAR",
    "IGHV3-30*01": "QVQLVESGGGVVQPGRSLRLSCAASGFTFSSYGMHWVRQAPGKGLEWVAVIWYDGSNKYYADSVKGRFTISRDNSKNTLYLQMNSLRAEDTAVYYCAR",
    "IGHV3-33*01": "QVQLVESGGGVVQPGRSLRLSCAASGFTFSSYGMHWVRQAPGKGLEWVAVIWYDGSNEHYADSVKGRFTISRDNSKNTLYLQMNSLRAEDTAVYYCAK",
    "IGHV3-48*01": "EVQLVESGGGLVQPGGSLRLSCAASGFTFSSYSMNWVRQAPGKGLEWVSYISSSSSTIYYADSVKGRFTISRDNAKNSLYLQMNSLRAEDTAVYYCAR",
    "IGHV3-53*01": "EVQLVESGGGLVQPGGSLRLSCAASGFTFDDYAMHWVRQAPGKGLEWVSGISWNSGSIGYADSVKGRFTISRDNAKNSLYLQMNSLRAEDTAVYYCAR",
    "IGHV3-66*01": "EVQLVESGGGLVQPGGSLRLSCAASGFTFDDYAMHWVRQAPGKGLEWVSGISWNSGSIGYADSVKGRFTISRDNAKNSLYLQMNSLRAEDTAVYYCAR",
    "IGHV4-4*02": "QVQLQESGPGLVKPSETLSLTCTVSGGSISSYYWSWIRQPPGKGLEWIGYIYYSGSTNYNPSLKSRVTISVDTSKNQFSLKLSSVTAADTAVYYCAR",
    "IGHV4-34*01": "QVQLQESGPGLVKPSQTLSLTCTVSGGSISSGDYYWSWIRQPPGKGLEWIGYIYYSGSTYYNPSLKSRVTISVDTSKNQFSLKLSSVTAADTAVYYCAR",
    "IGHV4-39*01": "QLQLQESGPGLVKPSETLSLTCTVSGGSISSSSYYWGWIRQPPGKGLEWIGSIYYSGSTYYNPSLKSRVTISVDTSKNQFSLKLSSVTAADTAVYYCAR",
    "IGHV4-59*01": "QVQLQESGPGLVKPSETLSLTCTVSGGSISSYYWSWIRQPPGKGLEWIGYIYYSGSTNYNPSLKSRVTISVDTSKNQFSLKLSSVTAADTAVYYCAR",
    "IGHV5-51*01": "EVQLVQSGAEVKKPGESLKISCKGSGYSFTSYWIGWVRQMPGKGLEWMGIIYPGDSDTRYSPSFQGQVTISADKSISTAYLQWSSLKASDTAMYYCAR",
    "IGHV6-1*01": "QVQLQQSGPGLVKPSQTLSLTCAISGDSVSSNSAAWNWIRQSPSRGLEWLGRTYYRSKWYNDYAVSVKSRITINPDTSKNQFSLQLNSVTPEDTAVYYCAR",
}

# Human germline sequences, light chain.
LIGHT_GERMLINES = {
    "IGKV1-5*03": "DIQMTQSPSSLSASVGDRVTITCRASQSISSYLNWYQQKPGKAPKLLIYAASSLQSGVPSRFSGSGSGTDFTLTISSLQPEDFATYYCQQSYSTPLT",
    "IGKV1-9*01": "DIQLTQSPSFLSASVGDRVTITCRASQGISSYLAWYQQKPGKAPKLLIYAASTLQSGVPSRFSGSGSGTEFTLTISSLQPEDFATYYCQQLNSYPLT",
    "IGKV1-12*01": "DIQMTQSPSSLSASVGDRVTITCRASQSISSYLNWYQQKPGKAPKLLIYAASSLQSGVPSRFSGSGSGTDFTLTISSLQPEDFATYYCQQSYSTPRT",
    "IGKV1-27*01": "DIQMTQSPSSLSASVGDRVTITCRASQGISNYLNWYQQKPGKAPKLLIYAASSLQSGVPSRFSGSGSGTDFTLTISSLQPEDFATYYCQQSYSTPPT",
    "IGKV1-33*01": "DIQMTQSPSSLSASVGDRVTITCQASQDISNYLNWYQQKPGKAPKLLIYDASNLETGVPSRFSGSGSGTDFTFTISSLQPEDIATYYCQQYDNLPLT",
    "IGKV1-39*01": "DIQMTQSPSSLSASVGDRVTITCRASQSISSYLNWYQQKPGKAPKLLIYAASSLQSGVPSRFSGSGSGTDFTLTISSLQPEDFATYYCQQSYSTPYT",
    "IGKV2-28*01": "DIVMTQSPLSLPVTPGEPASISCRSSQSLLHSNGYNYLDWYLQKPGQSPQLLIYLGSNRASGVPDRFSGSGSGTDFTLKISRVEAEDVGVYYCMQALQTPLT",
    "IGKV3-11*01": "EIVLTQSPGTLSLSPGERATLSCRASQSVSSSYLAWYQQKPGQAPRLLIYGASSRATGIPDRFSGSGSGTDFTLTISRLEPEDFAVYYCQQYGSSPRT",
    "IGKV3-15*01": "EIVMTQSPATLSVSPGERATLSCRASQSVSSNLAWYQQKPGQAPRLLIYGASTRATGIPARFSGSGSGTEFTLTISSLQSEDFAVYYCQQYNNWPLT",
    "IGKV3-20*01": "EIVLTQSPGTLSLSPGERATLSCRASQSVSSSYLAWYQQKPGQAPRLLIYGASSRATGIPDRFSGSGSGTDFTLTISRLEPEDFAVYYCQQYGSSPWT",
    "IGKV4-1*01": "DIVMTQSPDSLAVSLGERATINCKSSQSVLYSSNNKNYLAWYQQKPGQPPKLLIYWASTRESGVPDRFSGSGSGTDFTLTISSLQAEDVAVYYCQQYYSTPRT",
    "IGLV1-40*01": "QSVLTQPPSASGTPGQRVTISCSGSSSNIGSNTVNWYQQLPGTAPKLLIYSDNQRPSGVPDRFSGSKSGTSASLAISGLQSEDEADYYCAAWDDSLNGWV",
    "IGLV1-44*01": "QSVLTQPPSASGTPGQRVTISCSGSSSNIGSNYVYWYQQLPGTAPKLLIYRDNQRPSGVPDRFSGSKSGTSASLAISGLRSEDEADYYCAAWDDSLSGWV",
    "IGLV1-47*01": "QSVLTQPPSASGTPGQRVTISCSGSSSNIGSNTVNWYQQLPGTAPKLLIYSNNQRPSGVPDRFSGSKSGTSASLAISGLQSEDEADYYCAAWDDSLNGPV",
    "IGLV1-51*01": "QSVLTQPPSVSAAPGQKVTISCSGSSSNIGNNYVSWYQQLPGTAPKLLIYDHTNRPAGVPDRFSGSKSGTSATLGITGLQTGDEADYYCGTWDSSLSAWV",
    "IGLV2-8*01": "QSALTQPRSVSGSPGQSVTISCTGTSSDVGGYNYVSWYQQHPGKAPKLMIYDVSNRPSGVSNRFSGSKSGNTASLTISGLQAEDEADYYCSSYTSSSTLVV",
    "IGLV2-14*01": "QSALTQPASVSGSPGQSITISCTGTSSDVGSYNLVSWYQQHPGKAPKLMIYEGSKRPSGVSNRFSGSKSGNTASLTISGLQAEDEADYYCCSYAGSYTLV",
    "IGLV3-1*01": "SYELTQPPSVSVSPGQTASITCSGDKLGDKYACWYQQKPGQSPVLVIYQDSKRPSGIPERFSGSNSGNTATLTISGTQAMDEADYYCQAWDSSTAV",
    "IGLV3-19*01": "SYELTQPPSVSVAPGQTARITCGGNNIGSKSVHWYQQKPGQAPVLVIYYDDSDRPSGIPERFSGSNSGNTATLTISRVEAGDEADYYCQVWDSSSDHYV",
    "IGLV3-21*02": "SYVLTQPPSVSVAPGKTARITCGGNNIGSKSVHWYQQKPGQAPVLVVYDDSDRPSGIPERFSGSNSGNTATLTISRVEAGDEADYYCQVWDSSSDHPV",
    "IGLV6-57*01": "NFMLTQPHSVSESPGKTVTISCTRSSGSIASNYVQWYQQRPGSSPTTVIYDDDKRPSGVPDRFSGSIDSSSNSASLTISGLKTEDEADYYCQSYDSSNHWV",
}

# Liability motifs, charges' pKa (positive, negative), ends' pKa.
DEAMIDATION = ("NG", "NS", "NT", "ND", "NH", "NA", "NQ", "NK")
ISOMERIZATION = ("DG", "DS", "DT", "DD", "DH")
OXIDATION = ("MW", "MH", "MD", "MS")
SEQUON = "N[^P][ST]"
PKA_POSITIVE = {"H": 6.00, "K": 10.53, "R": 12.48}
PKA_NEGATIVE = {"D": 3.65, "E": 4.25, "C": 8.18, "Y": 10.07}
PKA_N_END, PKA_C_END = 9.69, 2.34
WATER = 18.015
# 0-based half-open ranges of the complementarity-determining regions.
CDR_RANGES = ((26, 38), (55, 65), (104, 117))
